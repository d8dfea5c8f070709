"""Fixed values.

These constants define the behaviour being reproduced (symbol vocabulary,
keyword lists, patterns, thresholds, intent prototypes).  They must keep these
exact values for results to agree; patterns are written for Java regex, which
is what Spark's ``rlike``/``split``/``regexp_*`` use.
"""

# ---- fixed values: market symbols recognised in messages --------------------
TICKERS = [
    "BTC", "ETH", "HPG", "SSI", "VND", "FPT", "VIC", "VNM", "MWG", "VCB", "MBB", "TCB",
    "ACB", "STB", "VPB", "VHM", "VRE", "GAS", "MSN", "PLX", "SAB", "BID", "CTG", "POW",
    "GVR", "SHB", "EIB", "TPB", "KDH", "KBC", "DGC", "VHC", "PVD", "PVS", "HSG", "NKG",
]

# ---- fixed values: clause connectors ---------------------------------------
CONNECTORS = ["và", "đồng thời", "cùng với"]

# ---- fixed values: chart-mode keyword lists, first matching list wins -------
CHART_MODE_KEYWORDS = [
    ("rsi", ["rsi", "quá mua", "quá bán", "overbought", "oversold"]),
    ("macd", ["macd", "phân kỳ", "divergence", "động lượng", "momentum"]),
    ("volume", ["volume", "khối lượng", "thanh khoản"]),
    ("price_sma", ["sma", "đường trung bình", "moving average", "ma5", "ma20"]),
]
DEFAULT_CHART_MODE = "comprehensive"
CHART_MODES = ["comprehensive", "price_sma", "rsi", "macd", "volume"]

# ---- fixed values: words that ask for a chart -------------------------------
CHART_WORDS = ["biểu đồ", "đồ thị", "vẽ", "chart", "graph", "visualize", "draw"]

# ---- fixed values: guard patterns (case-insensitive) -----------------------
SQL_INJECTION_PATTERN = r"(\b(DROP|DELETE|ALTER|TRUNCATE|UPDATE)\b\s+\b(TABLE|FROM|DATABASE|KEY)\b)|(--)|(\/\*|\*\/)"
PROMPT_INJECTION_PATTERN = r"(ignore\s+previous\s+instructions|system\s+prompt|bypass\s+security)"

# ---- fixed values: Markdown table and sentence boundary patterns -----------
TABLE_PATTERN = r"(?:\|[^\n]+\|\n\|(?:[\s]*:?-+:?[\s]*\|)+\n(?:\|[^\n]+\|\n*)+)"
SENTENCE_ABBREVIATIONS = ["VND", "Inc", "Ltd", "Jan", "Feb", "Mar", "Apr", "May", "Jun",
                          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SENTENCE_END_PATTERN = (
    r"(?U)(?<=[.!?])"
    r"(?<!\b(?:" + "|".join(SENTENCE_ABBREVIATIONS) + r")\.)"
    r"(?<!\bU\.S\.)"
    r"(?<!\bCorp\.)"
    r"(?<!\bvs\.)"
    r"\s+"
)
TABLE_PLACEHOLDER = "__TABLE_PLACEHOLDER_{}__"

# ---- fixed values: chunk sizes ----------------------------------------------
PARENT_SIZE = 1200
CHILD_SIZE = 250
PARAGRAPH_SEP = "\n\n"

# ---- fixed values: retrieval ------------------------------------------------
SPARSE_BUCKETS = 1_000_000
PREFETCH_K = 10
FUSED_K = 10
RRF_K = 60
MIN_RERANK_SCORE = 0.1
CONTEXT_PREFIX = 150
MAX_CONTEXTS = 2
NO_HITS_MESSAGE = "No related macro-financial documents found in Vector DB."

# ---- fixed values: routing --------------------------------------------------
ROUTER_THRESHOLD = 0.55
SECONDARY_MARGIN = 0.06
FALLBACK_MARGIN = 0.10
MAX_HISTORY_TOKENS = 800
UNKNOWN_TICKER = "UNKNOWN"

# ---- fixed values: intent prototype utterances ------------------------------
INTENT_UTTERANCES = {
    "FETCH_PRICE": [
        "giá cổ phiếu hôm nay bao nhiêu",
        "lịch sử giá giao dịch",
        "cho xem khối lượng volume giao dịch",
        "giá mở cửa giá đóng cửa",
        "biến động giá hôm nay",
        "stock price quote history volume",
        "giá thị trường hiện tại",
    ],
    "FETCH_INDICATOR": [
        "chỉ số rsi đang ở mức nào",
        "đường trung bình sma 20 ngày",
        "tín hiệu macd phân kỳ",
        "chỉ báo kỹ thuật quá mua quá bán",
        "xu hướng kỹ thuật technical indicators",
        "rsi macd moving average signals",
        "tín hiệu đường ma",
    ],
    "FETCH_NEWS": [
        "tin tức kinh tế vĩ mô mới nhất",
        "báo cáo tài chính doanh nghiệp",
        "triển vọng ngành thép kinh doanh",
        "chính sách lãi suất ngân hàng nhà nước fed",
        "dự án dung quất thông tin sự kiện",
        "macroeconomic financial news report outlook",
    ],
    "RENDER_CHART": [
        "vẽ biểu đồ giá",
        "vẽ đồ thị rsi",
        "vẽ hình kỹ thuật macd",
        "hiển thị chart phân tích",
        "plot chart visualize graph",
        "vẽ đồ thị phân tích kỹ thuật",
    ],
    "CHITCHAT": [
        "xin chào bạn",
        "chào bot",
        "bạn là ai",
        "hôm nay thế nào",
        "hôm nay thời tiết thế nào",
        "cảm ơn bạn nhé",
        "tạm biệt bot",
        "hello hi there how are you",
        "bạn có thể làm được những gì",
        "trò chuyện tâm sự một chút",
        "chúc một ngày tốt lành",
    ],
}

# ---- fixed values: indicator parameters -------------------------------------
SMA_FAST = 5
SMA_SLOW = 20
RSI_PERIOD = 14
RSI_EPS = 1e-9
EMA_FAST = 12
EMA_SLOW = 26
EMA_SIGNAL = 9
WINDOW_ROWS = 30
MAX_LIMIT = 30
