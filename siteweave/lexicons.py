"""Lexicons and rule tables.

Everything in this file is a fixed value: word lists, lookup tables, patterns and texts that have to be
exactly these for results to be right.  Two editions exist: the one the operators use by default, and the
declared extended one (suffix ``_EXT``), which operators take as a parameter.
"""

# ---- page types -----------------------------------------------------------------------------------------
PAGE_TYPES = ["archaeological-sites", "monuments", "museums", "sunken-monuments"]
PAGE_TYPE_LABELS = {
    "archaeological-sites": "Archaeological Sites",
    "monuments": "Monuments",
    "museums": "Museums",
    "sunken-monuments": "Sunken Monuments",
}
BASE_URL = "https://egymonuments.gov.eg"
GEOCODER_URL = "https://nominatim.openstreetmap.org/search"
MAPS_SEARCH_URL = "https://www.google.com/maps/search/"

# ---- paragraph filters ----------------------------------------------------------------------------------
STOP_PHRASES = ["copyright", "developed by", "all rights reserved", "read more", "click here"]
MIN_PARAGRAPH = 40
FOOTER_PHRASES_EXT = ["copyright", "developed by", "all rights reserved", "ministry of"]
NAVIGATION_PHRASES_EXT = ["read more", "click here", "show more", "back to", "home >"]
MIN_SENTENCE_EXT = 30

# ---- ordered classification rules: (keywords, class), first match wins ----------------------------------
ERA_RULES = [
    (["old kingdom"], "Old Kingdom"),
    (["middle kingdom"], "Middle Kingdom"),
    (["new kingdom", "18th dynasty", "19th dynasty"], "New Kingdom"),
    (["ptolemaic"], "Ptolemaic"),
    (["roman"], "Roman"),
    (["islamic", "mamluk", "fatimid"], "Islamic"),
    (["coptic"], "Roman"),
]
TOURISM_BY_ERA = [
    (["Old Kingdom", "Middle Kingdom", "New Kingdom", "Late Period"], "Pharaonic"),
    (["Roman", "Ptolemaic"], "Greco-Roman"),
    (["Islamic"], "Islamic"),
]
TOURISM_RULES = [
    (["mosque", "islamic", "madrasa"], "Islamic"),
    (["coptic", "church", "monastery"], "Coptic"),
    (["roman", "greek", "ptolem"], "Greco-Roman"),
]
TOURISM_DEFAULT = "Pharaonic"
PLACE_RULES = [
    (["pyramid"], "Pyramid"),
    (["temple"], "Temple"),
    (["tomb"], "Tomb"),
    (["cemetery"], "Tomb"),
    (["museum"], "Museum"),
    (["mosque"], "Mosque"),
    (["church"], "Church"),
    (["monastery"], "Church"),
    (["fortress"], "Fortress"),
    (["citadel"], "Fortress"),
    (["theater"], "Monument"),
    (["amphitheatre"], "Monument"),
]
PLACE_DEFAULT = "Ruins"
ERA_RULES_EXT = [
    (["predynastic", "pre-dynastic"], "Pre-Dynastic"),
    (["old kingdom", "early dynastic"], "Old Kingdom"),
    (["middle kingdom"], "Middle Kingdom"),
    (["new kingdom", "18th dynasty", "19th dynasty", "20th dynasty"], "New Kingdom"),
    (["late period"], "Late Period"),
    (["ptolemaic", "ptolemy", "greek", "hellenistic"], "Ptolemaic"),
    (["roman", "byzantine", "coptic"], "Roman"),
    (["islamic", "fatimid", "mamluk", "ayyubid", "ottoman"], "Islamic"),
    (["muhammad ali", "modern", "19th century", "20th century"], "Modern"),
]
PLACE_RULES_EXT = [
    (["pyramid"], "Pyramid"),
    (["temple"], "Temple"),
    (["tomb", "cemetery", "necropolis", "burial"], "Tomb"),
    (["museum"], "Museum"),
    (["mosque", "madrasa"], "Mosque"),
    (["church", "cathedral", "monastery", "convent"], "Church"),
    (["fortress", "citadel", "fort", "castle"], "Fortress"),
    (["market", "bazaar", "khan"], "Market"),
    (["amphitheatre", "theater", "theatre", "obelisk", "statue", "colossus"], "Monument"),
]
ERA_DOMAIN = [
    "Pre-Dynastic", "Old Kingdom", "Middle Kingdom", "New Kingdom", "Late Period",
    "Ptolemaic", "Roman", "Islamic", "Modern",
]
TOURISM_DOMAIN = ["Pharaonic", "Greco-Roman", "Coptic", "Islamic", "Modern"]
PLACE_DOMAIN = [
    "Pyramid", "Temple", "Tomb", "Museum", "Mosque", "Church", "Fortress", "Market", "Monument", "Ruins",
]

# ---- article patterns -----------------------------------------------------------------------------------
ARTICLE_PHARAOHS = [
    "Ramesses", "Ramses", "Amenhotep", "Thutmose", "Tutankhamun", "Khufu", "Khafre", "Menkaure",
    "Hatshepsut", "Akhenaten", "Seti", "Ptolemy", "Cleopatra", "Nefertiti", "Sneferu", "Djoser",
    "Cheops", "Zoser",
]
ARTICLE_NUMERAL = "[IVX]*"
ARTICLE_DEITIES = [
    "Amun", "Ra", "Horus", "Isis", "Osiris", "Hathor", "Thoth", "Ptah", "Anubis", "Sobek", "Sekhmet",
    "Bastet", "Mut", "Aten", "Min", "Khnum", "Khonsu", "Nefertum", "Neith",
]
ARTICLE_FEATURES = [
    "hypostyle hall", "pylon", "sanctuary", "obelisk", "colossus", "sphinx", "mastaba", "serdab", "pyramid",
    "mortuary temple", "valley temple", "causeway", "sacred lake", "colonnade", "peristyle", "naos",
    "pronaos",
]
ARTICLE_PERIODS = [
    "Old Kingdom", "Middle Kingdom", "New Kingdom", "Late Period", "Ptolemaic", "Roman", "Byzantine",
    "Coptic", "Islamic", "Mamluk", "Ottoman", "Pre-Dynastic", "Early Dynastic", "First Intermediate",
    "Second Intermediate", "Third Intermediate",
]
INTRO_CHARS = 2000
FACT_SUPERLATIVES = [
    "oldest", "largest", "first", "only", "unique", "rare", "famous", "renowned", "best-preserved", "most",
    "earliest", "longest", "highest", "deepest",
]
FACT_PHRASES = [
    "UNESCO", "World Heritage", "discovered in", "built in", "constructed in", "dating to", "dates back",
    "excavated", "uncovered",
]
FACT_YEAR_MARKS = ["BC", "BCE", "AD", "CE", r"B\.C\.", r"A\.D\."]
FACT_UNITS = ["meters?", "feet", "acres?", "hectares?", "square"]
FACT_LENGTHS = (30, 300)
MAX_FACTS = 5
MAX_FIGURES = 10
RELEVANCE_KEYWORDS = [
    "egypt", "egyptian", "pharaoh", "ancient", "temple", "tomb", "pyramid", "alexandria", "cairo", "luxor",
    "aswan", "archaeological", "roman", "ptolemaic",
]
TRANSLITERATIONS = [
    ("el-", "el "), ("el ", "el-"),
    ("al-", "al "), ("al ", "al-"),
    ("dikka", "deka"), ("deka", "dikka"),
    ("shek", "sheikh"), ("sheikh", "shek"),
]
PYRAMID_FIELDS = ["giza", "saqqara", "dahshur"]
SEARCH_HITS = 5

# ---- sub-locations: (pattern, prefix put before the captured text), in this order -----------------------
SUB_LOCATION_PATTERNS = [
    (r"Temple\s+of\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "Temple of "),
    (r"Tomb\s+of\s+([A-Z][a-z]+(?:\s+[IVX]+)?)", "Tomb of "),
    (r"(Great\s+(?:Temple|Pyramid|Sphinx))", ""),
    (r"(Hypostyle\s+Hall)", ""),
    (r"(Sacred\s+Lake)", ""),
]
MAX_SUB_LOCATIONS = 5
MAX_IMAGES = 5
SHORT_CHARS = 200

# ---- glossary: categories in priority order -------------------------------------------------------------
TERM_PHARAOHS = [
    "Ramesses", "Ramses", "Amenhotep", "Thutmose", "Tutankhamun", "Khufu", "Khafre", "Menkaure",
    "Hatshepsut", "Akhenaten", "Seti", "Sneferu", "Djoser", "Nefertiti", "Cleopatra", "Ptolemy",
]
TERM_NUMERAL = "(?:I{1,3}|IV|V|VI{1,3}|IX|X|XI{1,3})?"
TERM_DEITIES = [
    "Amun", "Amun-Ra", "Ra", "Re", "Horus", "Isis", "Osiris", "Hathor", "Thoth", "Ptah", "Anubis", "Sobek",
    "Sekhmet", "Bastet", "Mut", "Aten", "Min", "Khnum", "Khonsu", "Nefertum", "Neith", "Montu", "Set",
    "Seth", "Nephthys", "Maat", "Nut", "Geb", "Shu", "Tefnut",
]
TERM_ARCHITECTURE = [
    "hypostyle hall", "pylon", "sanctuary", "obelisk", "colossus", "sphinx", "mastaba", "serdab", "pyramid",
    "mortuary temple", "valley temple", "causeway", "sacred lake", "colonnade", "peristyle", "naos",
    "pronaos", "sarcophagus", "cartouche", "hieroglyph", "stele", "relief", "fresco", "mummy",
    "burial chamber", "false door", "offering table",
]
TERM_TITLES = [
    "pharaoh", "king", "queen", "vizier", "priest", "priestess", "scribe", "high priest", "god's wife",
    "royal wife", "prince", "princess",
]
TERM_PLACE_FEATURES = [
    "temple", "tomb", "chapel", "shrine", "necropolis", "cemetery", "fortress", "citadel", "mosque",
    "minaret", "dome", "mihrab", "church", "monastery", "basilica", "catacomb",
]
TERM_CATEGORIES = [
    ("pharaoh", TERM_PHARAOHS),
    ("deity", TERM_DEITIES),
    ("architecture", TERM_ARCHITECTURE),
    ("title", TERM_TITLES),
    ("place_feature", TERM_PLACE_FEATURES),
]
MAX_TERMS = 8
PRONUNCIATION = {
    "ramesses": "Ram-sees", "ramses": "Ram-sees", "amenhotep": "Ah-men-HO-tep", "thutmose": "Thut-MO-seh",
    "tutankhamun": "Too-tan-KAH-moon", "khufu": "KOO-foo", "khafre": "KAF-ray", "menkaure": "Men-KOW-ray",
    "hatshepsut": "Hat-SHEP-soot", "akhenaten": "Ak-en-AH-ten", "cleopatra": "Klee-oh-PAT-ra",
    "nefertiti": "Nef-er-TEE-tee",
    "amun": "AH-moon", "amun-ra": "AH-moon RAH", "ra": "RAH", "horus": "HOR-us", "isis": "EYE-sis",
    "osiris": "Oh-SY-ris", "hathor": "HATH-or", "anubis": "Ah-NOO-bis", "thoth": "THOTH", "ptah": "Puh-TAH",
    "hypostyle hall": "HY-po-style hall", "pylon": "PY-lon", "obelisk": "OB-eh-lisk",
    "sarcophagus": "Sar-KOF-ah-gus", "cartouche": "Kar-TOOSH", "hieroglyph": "HY-ro-glif",
    "mastaba": "Mas-TAH-ba",
    "minaret": "Min-ah-RET", "mihrab": "Mih-RAHB", "mosque": "MOSK",
}
PHONETIC_RULES = [("ph", "f"), ("kh", "kh"), ("th", "th"), ("ou", "oo"), ("ei", "ay"), ("ae", "ee")]

# ---- regions --------------------------------------------------------------------------------------------
REGION_ALIASES = {
    "alexandria": "Alexandria", "aswan": "Aswan", "asyut": "Asyut", "beheira": "Beheira",
    "beni suef": "Beni Suef", "cairo": "Cairo", "dakahlia": "Dakahlia", "damietta": "Damietta",
    "faiyum": "Faiyum", "fayoum": "Faiyum", "gharbia": "Gharbia", "giza": "Giza", "ismailia": "Ismailia",
    "kafr el sheikh": "Kafr El Sheikh", "kafr el-sheikh": "Kafr El Sheikh", "luxor": "Luxor",
    "matruh": "Matruh", "matrouh": "Matruh", "minya": "Minya", "al-minya": "Minya", "monufia": "Monufia",
    "menoufia": "Monufia", "new valley": "New Valley", "wadi al-jadid": "New Valley",
    "north sinai": "North Sinai", "port said": "Port Said", "qalyubia": "Qalyubia", "qena": "Qena",
    "red sea": "Red Sea", "sharqia": "Sharqia", "sharkia": "Sharqia", "al-sharkia": "Sharqia",
    "sohag": "Sohag", "south sinai": "South Sinai", "suez": "Suez",
}
REGION_NAMES = sorted(set(REGION_ALIASES.values()))
KNOWN_PLACES = [
    ("giza plateau", "Giza"), ("pyramids", "Giza"), ("sphinx", "Giza"), ("saqqara", "Giza"),
    ("dahshur", "Giza"), ("abu rawash", "Giza"),
    ("karnak", "Luxor"), ("valley of the kings", "Luxor"), ("valley of the queens", "Luxor"),
    ("deir el-bahari", "Luxor"), ("deir al-bahari", "Luxor"), ("medinet habu", "Luxor"),
    ("colossi of memnon", "Luxor"), ("luxor temple", "Luxor"),
    ("abu simbel", "Aswan"), ("philae", "Aswan"), ("elephantine", "Aswan"), ("nubian museum", "Aswan"),
    ("unfinished obelisk", "Aswan"),
    ("bibliotheca alexandrina", "Alexandria"), ("catacombs of kom el shoqafa", "Alexandria"),
    ("kom el-dikka", "Alexandria"), ("qaitbay citadel", "Alexandria"), ("pompey's pillar", "Alexandria"),
    ("egyptian museum", "Cairo"), ("cairo citadel", "Cairo"), ("khan el-khalili", "Cairo"),
    ("al-azhar", "Cairo"), ("coptic cairo", "Cairo"), ("old cairo", "Cairo"), ("heliopolis", "Cairo"),
    ("saint catherine", "South Sinai"), ("mount sinai", "South Sinai"), ("sharm el-sheikh", "South Sinai"),
    ("dahab", "South Sinai"),
    ("hurghada", "Red Sea"),
]
ADDRESS_FIELDS = ["state", "province", "county", "state_district"]
ADDRESS_SUFFIXES = [" governorate", " محافظة"]
COUNTRY = "Egypt"
GEO_BOUNDS = {"lat_min": 21, "lat_max": 32, "lon_min": 24, "lon_max": 37}

# ---- visitor advice -------------------------------------------------------------------------------------
GENERAL_TIPS = [
    "Bring water and wear comfortable walking shoes.",
    "Photography rules vary - check at the entrance.",
]
PYRAMID_TIPS = [
    "Visiting the interior requires a separate ticket and is not recommended for those with claustrophobia.",
    "Arrive early to avoid crowds and heat.",
]
TOMB_TIPS = [
    "Flash photography is prohibited to protect the ancient paintings.",
    "Only a limited number of tombs are open at any time - check which ones before visiting.",
]
TEMPLE_TIPS = [
    "Early morning or late afternoon provides the best lighting for photography.",
    "Consider hiring a licensed guide to understand the hieroglyphics and history.",
]
MUSEUM_TIPS = [
    "Audio guides are often available at the entrance.",
    "Large bags may need to be checked at the entrance.",
]
MOSQUE_TIPS = [
    "Dress modestly - shoulders and knees should be covered.",
    "Remove shoes before entering prayer areas.",
    "Non-Muslims may have restricted access during prayer times.",
]
CHURCH_TIPS = [
    "Dress modestly when visiting religious sites.",
    "Photography may be restricted in certain areas.",
]
CITY_RULES = [
    (["luxor", "aswan"], "The sun can be extremely intense - bring sunscreen and a hat."),
    (["alexandria"], "The Mediterranean breeze can make it cooler than Cairo - bring a light jacket."),
    (["cairo", "giza"],
     "Be prepared for persistent vendors and unofficial guides - politely decline if not interested."),
]
TOURISM_TIP_RULES = [
    (["pharaonic"], "Download a hieroglyphics guide app to understand the ancient inscriptions."),
    (["islamic"], "Visit outside of Friday prayer times for a calmer experience."),
]
MAX_CONTEXT_TIPS = 8
LARGE_COMPLEXES = ["karnak", "giza plateau", "valley of the kings", "saqqara"]
LARGE_DURATION = "3-4 hours"
DURATION_BY_TYPE = [
    (["temple"], "1-2 hours"),
    (["museum"], "2-3 hours"),
    (["pyramid"], "1-2 hours"),
    (["tomb", "mosque", "church"], "30 minutes - 1 hour"),
    (["fortress"], "1-2 hours"),
]
DEFAULT_DURATION = "1-2 hours"
BEST_TIME_BY_TYPE = [
    (["pyramid", "temple", "tomb", "ruins"],
     "Early morning (8-10 AM) or late afternoon (3-5 PM) to avoid heat"),
    (["museum"], "Weekday mornings for fewer crowds"),
    (["mosque"], "Mid-morning or mid-afternoon, outside prayer times"),
]
BEST_TIME_HOT = (["luxor", "aswan"],
                 "Early morning or late afternoon; winter months (Oct-Mar) are cooler")
DEFAULT_BEST_TIME = "Early morning for fewer crowds"
OFFICIAL_SITE_RULES = [
    (["egyptian museum"], "https://egymonuments.gov.eg/en/museums/the-egyptian-museum"),
    (["grand egyptian museum", "gem"], "https://grandegyptianmuseum.org"),
    (["bibliotheca", "library of alexandria"], "https://www.bibalex.org"),
]
OFFICIAL_DOMAINS = [
    "egymonuments.gov.eg", "tourism.gov.eg", "antiquities.gov.eg", "sca-egypt.org", "egypt.travel",
]
PRICE_PATTERNS = [r"EGP\s*(\d+)", r"(\d+)\s*EGP", r"(\d+)\s*Egyptian pounds?"]
PRICE_SOURCE = "egymonuments.gov.eg"
CITY_TIPS_EXT = {
    "Alexandria": "Bring sunscreen and a hat - the Mediterranean sun can be intense.",
    "Cairo": "Start early to avoid crowds and the midday heat.",
    "Giza": "Hire an official guide at the entrance for the best experience.",
    "Luxor": "Consider visiting early morning or late afternoon to avoid peak heat.",
    "Aswan": "Carry plenty of water, especially during summer months.",
}

# ---- opening hours --------------------------------------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HOURS_MARKS = ["monday", "tuesday", "sunday", "open", "closed"]
TIME_RANGE = r"(\d{1,2}(?::\d{2})?\s*(?:AM|PM)?)\s*[-–to]+\s*(\d{1,2}(?::\d{2})?\s*(?:AM|PM)?)"
MAP_COORDS = r"@(-?\d+\.\d+),(-?\d+\.\d+)"
RATING_NUMBER = r"(\d+\.?\d*)"
REVIEW_COUNT = r"([\d,]+)\s*review"

# ---- phrase book by place type: (english, arabic, pronunciation) ----------------------------------------
PHRASE_BOOK_EXT = {
    "Temple": [
        ("Temple", "معبد", "Ma'bad"), ("Pharaoh", "فرعون", "Fir'awn"),
        ("God/Goddess", "إله/إلهة", "Ilah/Ilaha"), ("Columns", "أعمدة", "A'mida"),
        ("Hieroglyphics", "هيروغليفية", "Hieroglyphia"),
    ],
    "Pyramid": [
        ("Pyramid", "هرم", "Haram"), ("King", "ملك", "Malik"), ("Chamber", "غرفة", "Ghorfa"),
        ("Stone", "حجر", "Hagar"),
    ],
    "Tomb": [
        ("Tomb", "مقبرة", "Maqbara"), ("Mummy", "مومياء", "Mumya"), ("Coffin", "تابوت", "Taboot"),
        ("Noble", "نبيل", "Nabeel"), ("Cemetery", "جبانة", "Gabbana"),
    ],
    "Mosque": [
        ("Mosque", "مسجد", "Masgid"), ("Minaret", "مئذنة", "Me'zana"), ("Dome", "قبة", "Qobba"),
        ("Prayer", "صلاة", "Salah"),
    ],
    "Museum": [
        ("Museum", "متحف", "Mat-haf"), ("Artifact", "أثر", "Athar"), ("Statue", "تمثال", "Timthal"),
        ("Collection", "مجموعة", "Magmoo'a"), ("Display", "عرض", "Ard"),
    ],
    "Monument": [
        ("Monument", "نصب تذكاري", "Nasb Tizkari"), ("Amphitheatre", "مدرج", "Mudarrag"),
        ("Theater", "مسرح", "Masrah"), ("Roman", "روماني", "Romani"),
        ("Mosaic", "فسيفساء", "Fusayfisa'"),
    ],
    "Ruins": [
        ("Ruins", "آثار", "Athar"), ("Ancient", "قديم", "Adeem"), ("Excavation", "حفريات", "Hafriyat"),
        ("Archaeology", "علم الآثار", "Ilm al-Athar"),
    ],
    "Fortress": [
        ("Fortress", "قلعة", "Qal'a"), ("Tower", "برج", "Borg"), ("Wall", "سور", "Soor"),
        ("Gate", "بوابة", "Bawwaba"),
    ],
    "Church": [
        ("Church", "كنيسة", "Kaneesa"), ("Coptic", "قبطي", "Qibti"), ("Monastery", "دير", "Deir"),
        ("Icon", "أيقونة", "Ayqoona"),
    ],
}
