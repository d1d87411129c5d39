"""Word lists, patterns, thresholds and formats that decide results.

These are data, not logic. They have to hold exactly these values for results to agree.
"""

# ---- thresholds ----
TEXT_SIMILARITY_THRESHOLD = 0.75
IMAGE_HASH_THRESHOLD = 10
TEXT_CAP_CHARS = 200_000
SAMPLED_FRAMES = 10
PREVIEW_ROWS = 20

# ---- file classes, by extension ----
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp"]
VIDEO_EXTENSIONS = ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm"]
TEXT_EXTENSIONS = ["txt", "pdf", "docx", "csv", "md", "html", "py", "js"]

# ---- utterances: (pattern, intent), the first that is found wins ----
INTENT_PATTERNS = [
    (r"\b(hi|hello|hey)\b", "greet"),
    (r"\b(bye|exit|quit|goodbye)\b", "goodbye"),
    (r"\bhelp\b", "help"),
    (r"\bstats?\b|\b(statistic|summary|count)\b", "stats"),
    (r"\bduplicate[s]?\s+between\b", "cross_user_dups"),
    (r"\bduplicates?\b.*\buser[s]?\b", "cross_user_dups"),
    (r"\balerts?\b|\bduplicates?\b|\bwarn\b", "alerts"),
    (r"\btoday\b", "by_date_today"),
    (r"\byesterday\b", "by_date_yesterday"),
    (r"\bthis\s+week\b", "by_date_week"),
    (r"\bthis\s+month\b", "by_date_month"),
    (r"\blast\s+month\b", "by_date_last_month"),
    (
        r"\b(larger|bigger|greater|more|>|above)\b.*\b(\d+)\s*(kb|mb|gb|b)\b"
        r"|\b(\d+)\s*(kb|mb|gb|b)\b.*\b(larger|bigger|greater|more|>|above)\b",
        "by_size_gt",
    ),
    (r"\bsize\s*[>]\s*(\d+)\s*(kb|mb|gb|b)?\b", "by_size_gt"),
    (
        r"\b(pdf|pdfs|txt|docx?|xlsx?|csv|mp[34]|avi|mkv|mov|jpg|jpeg|png|gif|zip|rar|exe|py|js|html?|md)s?\b",
        "by_type",
    ),
    (r"\bfrom\s+(?:user\s+)?(\w+)\b|\buser\s+(\w+)\b|\b(\w+)[''s]+\s+files?\b", "by_user"),
    (r"\b(all|every)\b.*\bfiles?\b", "list_all"),
    (r"\b(show|list)\b.*\b(files?|downloads?)\b", "list_all"),
    (r"\b(search|find|look|where|who)\b", "search"),
]
DEFAULT_INTENT = "search"

SIZE_PATTERN = r"(\d+(?:\.\d+)?)\s*(kb|mb|gb|b)\b"
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}

KNOWN_FILE_TYPES = [
    "pdf", "txt", "doc", "docx", "xls", "xlsx", "csv",
    "mp3", "mp4", "avi", "mkv", "mov", "wav", "flac",
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp",
    "zip", "rar", "7z", "tar", "gz",
    "exe", "msi", "py", "js", "html", "htm", "md", "json", "xml",
]

USER_PATTERNS = [
    r"\bfrom\s+(?:user\s+)?([A-Za-z0-9_]+)",
    r"\buser\s+([A-Za-z0-9_]+)",
    r"\b([A-Za-z0-9_]+)[''s]+\s+files?\b",
    r"\bshow\s+([A-Za-z0-9_]+)(?:\s+files?)?\b",
]
NOT_USER_NAMES = [
    "all", "the", "a", "an", "me", "my", "our", "your",
    "show", "list", "find", "search", "file", "files", "download",
    "downloads", "duplicate", "duplicates", "alert", "alerts",
    "today", "yesterday", "week", "month", "last", "this",
]
TWO_USER_PATTERNS = [
    r"\bbetween\s+([A-Za-z0-9_]+)\s+and\s+([A-Za-z0-9_]+)\b",
    r"\b([A-Za-z0-9_]+)\s+and\s+([A-Za-z0-9_]+)\s+duplicates?\b",
]
KEYWORD_STOP_WORDS = [
    "search", "find", "look", "for", "where", "is", "the", "a", "an",
    "show", "me", "please", "file", "files", "download", "downloads", "any",
    "all", "every", "list", "get",
]
KEYWORD_TOKENS = 5

# ---- alerts ----
ALERT_MESSAGE = (
    "⚠ Duplicate detected for %s!\n"
    "  New file : %s\n"
    "  Original : %s  (by %s)\n"
    "  Match    : %d%%  [%s]"
)

# ---- characters: word characters are letters, digits and the underscore of any script ----
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\t-\r\x1c-\x20\x{85}\p{Z}"

# ---- default stop words: the single words of Spark's published English list; any list can be passed ----
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now cannot could ought would"
).split()
