"""Fixed values of the listing classifier: word lists, code tables, units."""

# BEGIN FIXED VALUES: they must equal the source catalog's for right results

SET_CODE_PREFIXES = ["OP", "ST", "DP", "EB", "PRB", "DF"]

CATEGORY_OF_TYPE = {
    "ONE_PIECE": "one-piece",
    "EXTRA_BOOSTER": "extra-booster",
    "PREMIUM_BOOSTER_BOX": "premium-booster-box",
    "PREMIUM_CARD_COLLECTION": "premium-card-collection",
    "STARTER_DECK": "starter-deck",
    "ILLUSTRATION_BOX": "illustration-box",
    "DOUBLE_PACK": "double-pack",
    "DEVIL_FRUITS_COLLECTION": "devil-fruits-collection",
    "SLEEVES": "sleeves",
    "PLAYMAT": "playmat",
}
NOT_APPLICABLE_TYPES = ["LOTE_CARTAS", "PROMO_CARD", "MYSTERY_PACK", "DICE_ACCESSORY", "OTROS"]

#: Units in a display and in a case, by type.
PACKAGING_UNITS = {
    "STARTER_DECK": {"display": 6},
    "DOUBLE_PACK": {"display": 10},
    "PREMIUM_BOOSTER_BOX": {"display": 20, "case": 10},
    "ONE_PIECE": {"display": 24, "case": 12},
    "EXTRA_BOOSTER": {"display": 24, "case": 12},
}

#: Double pack -> booster it belongs to.
BOOSTER_OF_DOUBLE_PACK = {"DP01": "OP04", "DP02": "OP05", "DP03": "OP06", "DP04": "OP07", "DP05": "OP08", "DP06": "OP09", "DP07": "OP11", "DP08": "OP12", "DP09": "OP14", "DP10": "OP15", "DP11": "OP16", "DP12": "OP17"}

#: Title tables: part of a normalized title, code; the first that is found wins.
BOOSTER_TITLES = [
    ("romance dawn", "OP01"),
    ("paramount war", "OP02"),
    ("pillars of strength", "OP03"),
    ("pillard of strength", "OP03"),
    ("kingdoms of intrigue", "OP04"),
    ("awakening of the new era", "OP05"),
    ("wings of the captain", "OP06"),
    ("500 years in the future", "OP07"),
    ("500 years into the future", "OP07"),
    ("two legends", "OP08"),
    ("emperors in the new world", "OP09"),
    ("royal blood", "OP10"),
    ("a fist of divine speed", "OP11"),
    ("a fist divine speed", "OP11"),
    ("legacy of the master", "OP12"),
    ("legacy of the masters", "OP12"),
    ("carrying on his will", "OP13"),
    ("the azure seas seven", "OP14"),
    ("adventure on kamis island", "OP15"),
    ("the time of battle", "OP16"),
    ("the worlds strongest warriors", "OP17"),
]

PREMIUM_BOOSTER_TITLES = [
    ("the best 2", "PRB02"),
    ("the best vol 2", "PRB02"),
    ("the best vol.2", "PRB02"),
    ("the best", "PRB01"),
]

EXTRA_BOOSTER_TITLES = [
    ("heroines edition vol 2", "EB05"),
    ("heroines edition vol.2", "EB05"),
    ("heroines edition", "EB03"),
    ("memorial collection", "EB01"),
    ("anime 25th collection", "EB02"),
]

STARTER_DECK_TITLES = [
    ("straw hat crew", "ST01"),
    ("worst generation", "ST02"),
    ("the seven warlords of the sea", "ST03"),
    ("animal kingdom pirates", "ST04"),
    ("one piece film edition", "ST05"),
    ("absolute justice", "ST06"),
    ("big mom pirates", "ST07"),
    ("the three captains", "ST10"),
    ("zoro and sanji", "ST12"),
    ("the three brothers", "ST13"),
    ("3d2y", "ST14"),
    ("red edward newgate", "ST15"),
    ("green uta", "ST16"),
    ("blue donquixote doflamingo", "ST17"),
    ("purple monkey d luffy", "ST18"),
    ("black smoker", "ST19"),
    ("yellow charlotte katakuri", "ST20"),
    ("gear 5", "ST21"),
    ("ace newgate", "ST22"),
    ("red shanks", "ST23"),
    ("green jewelry bonney", "ST24"),
    ("blue buggy", "ST25"),
    ("purple black monkey d luffy", "ST26"),
    ("black marshall d teach", "ST27"),
    ("green yellow yamato", "ST28"),
    ("egghead", "ST29"),
    ("luffy ace", "ST30"),
    ("red monkey d luffy", "ST31"),
    ("green roronoa zoro", "ST32"),
    ("blue kuzan", "ST33"),
    ("purple charlotte katakuri", "ST34"),
    ("red black sabo", "ST35"),
    ("yellow eustass captain kid", "ST36"),
]

STARTER_DECK_CHARACTERS = [
    ("ace newgate", "ST22"),
    ("ace and newgate", "ST22"),
    ("luffy ace", "ST30"),
    ("luffy and ace", "ST30"),
    ("zoro and sanji", "ST12"),
    ("edward newgate", "ST15"),
    ("edward.newgate", "ST15"),
    ("straw hat crew", "ST01"),
    ("worst generation", "ST02"),
    ("seven warlords", "ST03"),
    ("animal kingdom pirates", "ST04"),
    ("absolute justice", "ST06"),
    ("big mom pirates", "ST07"),
    ("three captains", "ST10"),
    ("three brothers", "ST13"),
    ("3d2y", "ST14"),
    ("donquixote doflamingo", "ST17"),
    ("gear 5", "ST21"),
    ("gear5", "ST21"),
    ("jewelry bonney", "ST24"),
    ("marshall d.teach", "ST27"),
    ("marshall d teach", "ST27"),
    ("marshall.d.teach", "ST27"),
    ("roronoa zoro", "ST32"),
    ("eustass", "ST36"),
    ("captain kid", "ST36"),
    ("smoker", "ST19"),
    ("shanks", "ST23"),
    ("buggy", "ST25"),
    ("egghead", "ST29"),
    ("kuzan", "ST33"),
    ("sabo", "ST35"),
]

PREMIUM_CARD_EDITIONS = [
    ("25th edition", "ED25TH"),
    ("film red edition", "EDFILMRED"),
    ("best selection", "EDBEST"),
    ("live action edition", "EDLIVEACTION"),
    ("bandai card games fest", "EDFEST2324"),
    ("leader collection", "EDLEADER"),
    ("29th anniversary edition", "ED29TH"),
    ("ace sabo luffy", "EDACESABOLUFFY"),
]

PREMIUM_CARD_EDITIONS_SHORT = [
    ("25th", "ED25TH"),
    ("live action", "EDLIVEACTION"),
    ("fest", "EDFEST2324"),
    ("29th anniversary", "ED29TH"),
]

PLAYMAT_CHARACTERS = [
    ("trafalgar law", "LAW"),
    ("trafalgar.law", "LAW"),
    ("portgas d ace", "ACE"),
    ("portgas.d.ace", "ACE"),
    ("porgas d ace", "ACE"),
    ("eustass", "KID"),
    ("captain kid", "KID"),
    ("shanks", "SHANKS"),
    ("nami", "NAMI"),
]

SLEEVES_VARIANTS = [
    ("the three captains pixel art", "VOL06"),
    ("the three captains", "VOL04"),
    ("standard blue ver rocks d xebec", "VOL16"),
    ("crocodile", "VOL01"),
    ("kaido", "VOL01"),
    ("standard pink", "VOL02"),
    ("charlotte katakuri", "VOL03"),
    ("navy", "VOL03"),
    ("uta", "VOL03"),
    ("vinsmoke reiju", "VOL05"),
    ("zoro sanji", "VOL05"),
    ("standard green", "VOL05"),
    ("trafalgar law", "VOL06"),
    ("perona", "VOL06"),
    ("standard black pink", "VOL06"),
    ("ulti", "VOL07"),
    ("edward newgate", "VOL07"),
    ("silvers rayleigh", "VOL07"),
    ("the three brothers", "VOL07"),
    ("gecko moria", "VOL08"),
    ("sogeking", "VOL09"),
    ("sugar", "VOL09"),
    ("standard mint lemon", "VOL09"),
    ("kouzuki hiyori", "VOL10"),
    ("portgas d ace", "VOL10"),
    ("shanks", "VOL10"),
    ("kuzan", "VOL11"),
    ("donquixote rosinante", "VOL11"),
    ("monkey d luffy gear 5", "VOL12"),
    ("sabo", "VOL12"),
    ("gol d roger", "VOL12"),
    ("imu", "VOL12"),
    ("dracule mihawk", "VOL13"),
    ("hat patterns", "VOL13"),
    ("jewelry bonney", "VOL14"),
    ("brook laboon", "VOL14"),
    ("luffy ace", "VOL15"),
    ("impel down", "VOL15"),
    ("the three admirals", "VOL15"),
]

#: Label of a sealed booster in the catalog -> label of its box and of its case.
BOX_LABELS = {"Booster Pack:": "Booster Box:", "Extra Booster:": "Extra Booster Box:", "Premium Booster:": "Premium Booster Box:"}
CASE_LABELS = {"Booster Pack:": "Booster Box Case:", "Extra Booster:": "Extra Booster Box Case:", "Premium Booster:": "Premium Booster Box Case:"}
DISPLAY_LABELS = {"Starter Deck": "Starter Deck Display", "Double Pack Set": "Double Pack Set Display"}
#: Categories that are also sold in Japanese.
JAPANESE_CATEGORIES = ["one-piece", "extra-booster", "premium-booster-box", "double-pack", "starter-deck", "premium-card-collection"]

#: Words that name a language (lower case), and codes that do so in capitals only.
LANGUAGE_WORDS = {"JP": ["japones", "japonés"], "KR": ["coreano"], "EN": ["ingles", "inglés", "- en"], "ES": ["castellano", "español"]}
LANGUAGE_CODES = {"JP": r"\bJP\b", "EN": r"\bEN\b"}
NOT_ENGLISH = ["non-english", "non english"]

#: Words and patterns of the families, in lower-case text.
LOT_WORDS = ["cgc", "psa", "bgs", "lote"]
PROMO_WORDS = ["promo card", "carta promo", "promo pack", "promotion pack"]
PROMO_NUMBER = r"(?i)\bP-?\d{2,4}\b"
DON = r"\bdon!!"
DON_SEALED = r"\bset\b|\bpack\b|\bcaja\b|\bbox\b|\bsobres?\b"
MYSTERY_WORDS = ["mystery pack", "mystery box"]
DICE_WORDS = ["dice"]
DEVIL_FRUIT_WORDS = ["devil fruits collection", "fruta del diablo"]
ILLUSTRATION_WORDS = ["illustration box", "caja de ilustraciones"]
PLAYMAT_WORDS = ["playmat", "tapete"]
SLEEVE_WORDS = ["sleeve", "funda"]
CARD_COLLECTION_WORDS = ["premium card collection"]
LEARNING_WORDS = ["learn together", "learn to play", "aprende a jugar"]
DECK_WORDS = ["starter deck", "ultra deck", "mazo"]
DOUBLE_PACK_WORDS = ["double pack", "doble pack"]
EXTRA_BOOSTER_WORDS = ["extra booster"]
SEALED = r"\bbooster\b|\bcaja\b|\bsobres?\b"
ACCESSORY = "ultimate guard|comic mania|caja de almacenamiento|storage box"
CASE = r"(?i)\bcase\b"
DISPLAY = r"(?i)\bdisplay\b|\bcajas?\b|\bbox(es)?\b"
#: A deck's number behind its words, and the ways to write a double pack's.
DECK_NUMBERS = [r"\bstarter deck\s*0*(\d{1,2})\b", r"\bmazo\b(?:\s+one\s+piece)?\s*0*(\d{1,2})\b"]
DOUBLE_PACK_NUMBERS = [r"(?i)\bdouble pack set\s*0*(\d{1,3})\b", r"(?i)\bdouble pack.*?vol\.?\s*0*(\d{1,3})\b"]
SLEEVE_NUMBERS = [r"(?i)\bsleeves?\s*0*(\d{1,2})\b", r"(?i)\bv\.?\s*0*(\d{1,2})\b"]
LEARNING_NUMBER = r"(?i)\bLD[\s-]?0*(\d{1,2})\b"
VOLUME = r"(?i)\bvol\.?\s*0*(\d{1,3})\b"
#: Names that end in an ellipsis were cut; markup that leaked into a name; an amount with its currency sign on either side.
CUT_NAME = r"(\.\s*){2,}$|…\s*$"
LEAKED_TAG = r"</?[a-zA-Z][^<>]*>"
MONEY = r"(\d[\d.,]*\s*€|€\s*\d[\d.,]*)"
QUANTITY = r"(?i)\bpack\s*(\d+)\b|\b(\d+)\s*sobres\b|\bx\s*(\d+)\b"

# END FIXED VALUES

DOUBLE_PACK_TITLES = [(title, dp) for title, code in BOOSTER_TITLES for dp, op in BOOSTER_OF_DOUBLE_PACK.items() if code == op]
