"""Values that must stay as they are for results to match."""

# --- fixed values: attribute columns ------------------------------------------
CAT_COLS = ["province", "isp", "resourcetype", "deliverytype", "nattype", "dialtype", "device_type", "os"]
NUM_COLS = ["bw", "corenum", "memtotal", "totaldisksize", "hdddisksize", "ssddisksize", "systemdisksize"]

# --- fixed values: missing tokens of text inputs ------------------------------
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
UNKNOWN = "__UNK__"

# --- fixed values: business families ------------------------------------------
FAMILY_RULES = [("七牛CDN-虚拟", "FQCDNV"), ("七牛特招-虚拟", "FQTZV")]
FAMILY_REPRESENTATIVE = {"FQCDNV": "10000292", "FQTZV": "10000281"}
FAMILY_MEMBERS = {"10000292": "FQCDNV", "10000282": "FQCDNV", "10000281": "FQTZV", "10000279": "FQTZV"}

# --- fixed values: streak labels ----------------------------------------------
FULL_STREAK_LABEL = "近7天"
SHORT_STREAK_LABEL = "近%d天"

# --- fixed values: acceptance ranges (name, low, high) ------------------------
ACCEPTANCE_RANGES = [
    ("test_nodes", 2994.0, 2994.0),
    ("train_nodes", 11000.0, 12500.0),
    ("nodes_with_rec", 14000.0, 16000.0),
    ("hit1", 0.19, 0.23),
    ("hit3", 0.49, 0.55),
    ("wape", 0.0, 0.46),
    ("r2", 0.60, 1.0),
    ("profit_positive", 0.90, 1.0),
]
LEDGER_REQUIRED = ["node_id", "business", "business_name", "online_day", "outcome_days", "cum_cost_7d",
                   "cum_revenue_7d"]
ATTRS_REQUIRED = ["node_id", "deliverytype", "resourcetype", "province", "isp", "bw", "nattype", "dialtype",
                  "device_type", "os", "corenum", "memtotal", "totaldisksize", "hdddisksize", "ssddisksize",
                  "systemdisksize"]
LEDGER_ROW_FLOOR = 49000
ATTRS_ROW_FLOOR = 14900
