"""Word lists, alias tables, constants and patterns that results depend on."""

# Region (state) spellings after normalisation.
REGION_ALIASES = {
    "DADRA AND NAGAR HAVELI": "DADRA AND NAGAR HAVELI AND DAMAN AND DIU",
    "DAMAN AND DIU": "DADRA AND NAGAR HAVELI AND DAMAN AND DIU",
    "ANDAMAN AND NICOBAR ISLANDS": "ANDAMAN AND NICOBAR",
    "NCT OF DELHI": "DELHI",
    "PONDICHERRY": "PUDUCHERRY",
    "THE DADRA AND NAGAR HAVELI AND DAMAN AND DIU": "DADRA AND NAGAR HAVELI AND DAMAN AND DIU",
}

# Group (district) spellings after normalisation.
GROUP_ALIASES = {
    "BENGALURU URBAN": "BANGALORE URBAN",
    "BENGALURU RURAL": "BANGALORE RURAL",
    "BENGALURU SOUTH": "BANGALORE URBAN",
    "MYSURU": "MYSORE",
    "DAKSHIN KANNAD": "DAKSHINA KANNADA",
    "CHHATRAPATI SAMBHAJINAGAR": "AURANGABAD",
    "NASIK": "NASHIK",
    "DEHRA DUN": "DEHRADUN",
    "KANCHEEPURAM": "KANCHIPURAM",
    "THIRUVALLUR": "TIRUVALLUR",
    "SABAR KANTHA": "SABARKANTHA",
    "BANAS KANTHA": "BANASKANTHA",
    "MUMBAI": "MUMBAI CITY",
    "BID": "BEED",
    "BAGALKOTE": "BAGALKOT",
    "BARA BANKI": "BARABANKI",
    "BALESHWAR": "BALASORE",
    "ANUGUL": "ANGUL",
    "BADGAM": "BUDGAM",
    "AHILYANAGAR": "AHMEDNAGAR",
    "ALAPUZHA": "ALAPPUZHA",
    "BANGALORE": "BANGALORE URBAN",
    "GURGAON": "GURUGRAM",
    "RAIGARH MH": "RAIGAD",
    "CHHATRAPATI SAMBHAJI NAGAR": "AURANGABAD",
    "GAUTAMBUDDHA NAGAR": "GAUTAM BUDDHA NAGAR",
    "THE NILGIRIS": "NILGIRIS",
    "JHUJHUNU": "JHUNJHUNU",
    "HAMIRPUR HP": "HAMIRPUR",
    "HAMIRPUR UP": "HAMIRPUR",
    "PONDICHERRY": "PUDUCHERRY",
    "NORTH SIKKIM": "MANGAN",
    "SOUTH SIKKIM": "NAMCHI",
    "EAST SIKKIM": "GANGTOK",
    "WEST SIKKIM": "GYALSHING",
    "SOUTH SALMARA MANCACHAR": "SOUTH SALMARA MANKACHAR",
    "DOHAD": "DAHOD",
    "SAHEBGANJ": "SAHIBGANJ",
    "CHIKBALLAPUR": "CHIKKABALLAPUR",
    "DAVANGERE": "DAVANAGERE",
    "UTTAR KANNAD": "UTTARA KANNADA",
    "JAJAPUR": "JAJPUR",
    "MAHABUBNAGAR": "MAHBUBNAGAR",
    "KHOWAI": "KHOWAI A",
    "COOCHBEHAR": "COOCH BEHAR",
    "JANGOAN": "JANGAON",
    "KOMARAM BHEEM ASIFABAD": "KUMURAM BHEEM ASIFABAD",
    "Y S R": "YSR KADAPA",
    "CHUMOUKEDIMA": "CH MOUKEDIMA",
    "NORTH 24 PRAGANAS": "NORTH 24 PARGANAS",
    "FAZILKA": "FAZILKA A",
    "PASHCHIM CHAMPARAN": "WEST CHAMPARAN",
    "LEH LADAKH": "LEH",
    "NAN DED": "NANDED",
    "RAJNANDAGAON": "RAJNANDGAON",
    "AHMADABAD": "AHMEDABAD",
    "CHAMARAJNAGAR": "CHAMARAJANAGAR",
    "PATHANAMTHIPTA": "PATHANAMTHITTA",
    "MARIGAON": "MORIGAON",
    "SOUTH 24 PRAGANAS": "SOUTH 24 PARGANAS",
    "WEST MEDINIPUR": "PASCHIM MEDINIPUR",
    "CHITOOR": "CHITTOOR",
    "SPSR NELLORE": "NELLORE",
    "MAHESANA": "MEHSANA",
    "CHHOTAUDEPUR": "CHHOTA UDAIPUR",
    "DEVBHOOMI DWARKA": "DEVBHUMI DWARKA",
    "AMBEDAKAR NAGAR": "AMBEDKAR NAGAR",
    "KAMRUP METRO": "KAMRUP METROPOLITAN",
    "KAMRUP RURAL": "KAMRUP",
    "SIBSAGAR": "SIVASAGAR",
    "AURANGABAD BIHAR": "AURANGABAD",
    "KAIMUR BHABUA": "KAIMUR",
    "PURBA CHAMPARAN": "EAST CHAMPARAN",
}

# Sub-district renamings used before fuzzy matching.
PLACE_ALIASES = {
    "shivamogga": "shimoga",
    "vijayapura": "bijapur",
    "hosapete": "hospet",
    "mangaluru": "mangalore",
}
FUZZY_CUTOFF = 0.90

# Two-digit key prefix to region code; anything else is XX.
PREFIX_REGION = {
    "11": "DL", "12": "HR", "13": "HP", "14": "PB", "15": "PB", "16": "CH", "17": "HP",
    "18": "JK", "19": "JK",
    "20": "UP", "21": "UP", "22": "UP", "24": "UP", "25": "UP", "26": "UP", "27": "UP", "28": "UP",
    "30": "RJ", "31": "RJ", "32": "RJ", "33": "RJ", "34": "RJ",
    "36": "GJ", "37": "GJ", "38": "GJ", "39": "GJ",
    "40": "MH", "41": "MH", "42": "MH", "43": "MH", "44": "MH",
    "45": "MP", "46": "MP", "47": "MP", "48": "MP", "49": "CG",
    "50": "TS", "51": "AP", "52": "AP", "53": "AP",
    "56": "KA", "57": "KA", "58": "KA", "59": "KA",
    "60": "TN", "61": "TN", "62": "TN", "63": "TN", "64": "TN",
    "67": "KL", "68": "KL", "69": "KL",
    "70": "WB", "71": "WB", "72": "WB", "73": "WB", "74": "WB",
    "75": "OD", "76": "OD", "77": "OD", "78": "AS",
    "80": "BR", "81": "BR", "82": "JH", "83": "JH", "84": "BR", "85": "BR",
}
UNKNOWN_REGION = "XX"

# Signal priors per region, and the prior where the region is unknown.
PRIOR_FIELDS = ("rate", "dep", "nl", "itr", "c2w", "lux", "ev", "veh")
REGION_PRIORS = {
    "DL": (18010, 399318, 38.0, 0.1836, 0.319, 0.0424, 0.061, 43.2),
    "MH": (27000, 570000, 46.0, 0.2465, 0.477, 0.1392, 0.0429, 20.1),
    "KA": (12000, 320000, 36.0, 0.1760, 0.358, 0.0759, 0.0963, 74.1),
    "HR": (19000, 550000, 40.0, 0.2120, 1.650, 0.1250, 0.060, 70.0),
    "TS": (6684, 231802, 33.5, 0.1513, 0.298, 0.0458, 0.0392, 38),
    "AP": (4876, 179847, 27.2, 0.1261, 0.269, 0.0393, 0.0261, 32),
    "TN": (6920, 239795, 30.8, 0.1597, 0.227, 0.0393, 0.0392, 36),
    "GJ": (5977, 215816, 29.9, 0.1765, 0.319, 0.0524, 0.0523, 40),
    "WB": (5662, 195833, 32.6, 0.1177, 0.156, 0.0327, 0.0261, 28),
    "PB": (6291, 211819, 27.2, 0.1513, 0.354, 0.0458, 0.0261, 44),
    "RJ": (5190, 177449, 25.4, 0.1177, 0.283, 0.0393, 0.0261, 36),
    "MP": (4404, 155068, 21.8, 0.1093, 0.255, 0.0327, 0.0261, 30),
    "KL": (5662, 195034, 23.6, 0.1681, 0.198, 0.0327, 0.0392, 32),
    "UP": (6448, 187840, 27.2, 0.1429, 0.298, 0.0393, 0.0392, 36),
}
DEFAULT_PRIOR = (7000, 220000, 28.0, 0.14, 0.32, 0.045, 0.038, 34)
DEFAULT_POI_MEDIAN = 15.0
FINANCE_DENSITY_MEDIAN = 0.04

# Ordered keyword classes of financial offices (first class that matches wins).
OFFICE_CLASSES = (
    ("sfb", (
        "ujjivan", "equitas", "au small finance", "au sfb", "jana small finance", "jana sfb",
        "suryoday", "esaf", "utkarsh", "capital small finance", "fincare",
        "north east small finance", "shivalik small finance", "unity small finance", "savein",
        "northeast sfb",
    )),
    ("rrb", (
        "gramin bank", "grameena bank", "regional rural bank", "kshetriya gramin",
        "pragathi krishna", "kaveri grameena", "canara bank (gramin)", "andhra pragathi",
        "chaitanya godavari", "bangiya gramin", "paschim banga", "madhyanchal gramin",
        "baroda rajasthan", "rajasthan marudhara", "uttar bihar", "dakshin bihar",
        "jharkhand rajya gramin", "vananchal gramin", "chhattisgarh rajya gramin",
        "vidarbha konkan gramin",
    )),
    ("coop", (
        "saraswat", "cosmos co-op", "cosmos bank", "svc bank", "tjsb", "nkgsb", "abhyudaya",
        "janata sahakari", "mahesh bank", "sahakari bank", "co-operative bank",
        "cooperative bank", "urban co-op", "nagpur nagarik", "zoroastrian",
        "the shamrao vithal", "apna sahakari", "mandvi co-op", "goa urban",
    )),
)

# Luxury car makers and brands, and the price that alone counts as luxury.
LUXURY_MAKERS = (
    "BMW INDIA", "MERCEDES-BENZ", "JAGUAR LAND ROVER", "AUDI INDIA", "SKODA AUTO VOLKSWAGEN",
    "VOLVO AUTO INDIA", "VOLVO CAR", "FERRARI", "LAMBORGHINI", "PORSCHE", "ROLLS-ROYCE",
    "BENTLEY", "MASERATI", "ASTON MARTIN",
)
LUXURY_BRANDS = (
    "mercedes", "bmw", "audi", "jaguar", "land rover", "porsche", "bentley", "rolls royce",
    "maserati", "lamborghini", "ferrari", "volvo", "lexus", "infiniti", "genesis",
)
LUXURY_PRICE = 2_000_000

# Area units in square feet, keyed without dots and spaces.
UNIT_SQFT = {
    "sqft": 1.0, "sqm": 10.764, "cent": 435.6, "bigha": 27000.0, "gunta": 1089.0,
    "marla": 272.25, "kanal": 5445.0, "acre": 43560.0,
}
RATE_MIN, RATE_MAX = 500, 500_000

# Tax zone letter to label and index band.
ZONES = {
    "A": ("CBD / prime commercial", 128, 150),
    "B": ("Near-CBD / premium residential", 112, 130),
    "C": ("Mid-city residential", 96, 115),
    "D": ("Outer residential", 82, 98),
    "E": ("Peripheral residential", 65, 82),
    "F": ("Far peripheral / semi-rural", 50, 67),
}

# Survey bands mangled by spreadsheets, and the two bands around the median.
BAND_FIXES = {"05-Oct": "5-10", "Oct-20": "10-20"}
MEDIAN_BANDS = ("40-50", "50-60")

# Office type ranks for the representative row of a key.
OFFICE_RANK = {"H.O": 0, "S.O": 1, "B.O": 2}
OTHER_OFFICE_RANK = 3

# Patterns for fields in free text.
AMOUNT_PATTERN = (
    r"(?i)(?:sale\s*(?:consideration|value|deed\s*value)|(?:market|circle|guidance)\s*value|"
    r"consideration\s*amount|total\s*consideration)[\s:\-]*(?:rs\.?|inr|₹)\s*([\d,]+(?:\.\d+)?)"
)
AREA_PATTERN = (
    r"(?i)(?:total\s*area|built[\-\s]?up\s*area|plot\s*area|land\s*area)[\s:\-]*([\d,\.]+)\s*"
    r"(sq\.?\s*ft\.?|sq\.?\s*m\.?|sqft|sqm|cent|bigha|gunta|marla|kanal|acre)"
)
RATE_PATTERN = (
    r"(?i)(?:rate|price)\s*(?:per\s*)?sq\.?\s*ft\.?[\s:\-]*(?:rs\.?|inr|₹)\s*([\d,]+(?:\.\d+)?)"
)
FUEL_PATTERN = r"(?i)fuel\s*type\s*[\s:\-]*([A-Za-z/]+)"
CLASS_PATTERN = r"(?i)vehicle\s*class\s*[\s:\-]*([A-Z0-9/]+)"
OWNER_CODE_PATTERN = r"(?is)owner.*?address.*?(\d{6})"
PRICE_PATTERN = (
    r"(?i)(?:purchase|ex[\-\s]showroom|invoice)\s*(?:price|value|amount)"
    r"[\s:\-]*(?:rs\.?|inr|₹)\s*([\d,]+)"
)
REGION_ROW_PATTERN = (
    r"(?i)(maharashtra|karnataka|delhi|telangana|uttar\s*pradesh|haryana|rajasthan|gujarat|"
    r"tamil\s*nadu|west\s*bengal)[\s|:]+(\d[\d,\.]+)\s+[\|]?\s*(\d[\d,\.]+)"
)
YEAR_LABEL_PATTERN = r"(?i)(?:assessment\s+year|AY|A\.Y\.)\s*[:\-]?\s*(\d{4}-\d{2,4})"
YEAR_PATTERN = r"\b(20\d{2}-\d{2,4})\b"
