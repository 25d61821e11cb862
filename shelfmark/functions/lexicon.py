"""Word lists, patterns, templates and thresholds.

Everything here must equal the published behaviour for results to agree, so
the values are stated as plain text and kept together.
"""

# --- fixed values: token stop lists for free-text search queries -------------
QUERY_STOPWORDS = (
    "a about an and are be can do does finds for from guy guys how in into is it keep keeps manga anime of on or "
    "people should that the their them they thrown to who with"
).split()
CHARACTER_HINTS = "character characters named name alias aliases".split()
SCAFFOLD_WORDS = "series title find".split()
TITLE_QUERY_HINTS = (
    "about where with who whose vibe plot story finds looking searching recommend recommendation guy girl boy woman man"
).split()

# --- fixed values: markers of recaps, sequels and specials -------------------
SPINOFF_MARKERS = "recap rewrite ova special movie season part ii iii iv 2nd 3rd 4th zero".split()

# --- fixed values: ordered vowel shortening for romanised names --------------
ROMAN_PAIRS = [("ou", "o"), ("oo", "o"), ("uu", "u"), ("aa", "a"), ("ii", "i"), ("oh", "o")]

# --- fixed values: suffixes that users glue onto the preceding word ----------
FUSED_SUFFIXES = "euro reul neun eul eun gwa ui wa ro ga".split()

# --- fixed values: stop words of the listing-title similarity ----------------
TITLE_STOPWORDS = "a an and at by for from in is it of on or the to who with".split()

# --- fixed values: stop words of the suggestion Jaccard score ----------------
SUGGESTION_STOPWORDS = "the a an part season chapter episode manga manhwa comic webtoon".split()

# --- fixed values: section labels of the labelled document text --------------
SECTION_LABELS = [
    "character search aliases:", "characters:", "synopsis:", "genres:", "type:", "title:",
]
NO_SYNOPSIS = "No synopsis available."
UNKNOWN = "Unknown"
UNKNOWN_ROLE = "Unknown role"
NO_BIO = "No bio available."

# --- fixed values: text patterns (Java / RE2 common subset) ------------------
TAG_RE = r"<[^>]+>"
BOILERPLATE_RE = r"(?i)\[(?:Written|Adapted)\s+by\s+MAL\s+Rewrite\]|\bSource:\s*[^.\n]+"
CJK_CLASS = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}"
ARABIC_CLASS = r"\x{0600}-\x{06ff}"
PLOT_WORDS_RE = (
    r"(?i)\b(?:find|finds|found|about|where|who|what|when|why|how|recommend|similar|like|with|without|boy|girl|guy|"
    r"man|woman|mc|main character|character|kills?|dies?|reincarnat|transported|isekai|revenge|overpowered|betrayed|"
    r"school|vampire|hunter|demon|plot)\b"
)
VAGUE_SIGNALS = [
    "about", "where", "who", "guy", "girl", "story", "plot", "vibe", "find", "looking for", "something like",
]
HEADLINE_RE = (
    r"(?i)^(?:best\s+|where\s+|how\s+|top\s+\d+|the\s+best\s+|official\s+|a\s+(?:fan|complete|beginner|full|quick|"
    r"simple)\s+(?:'s\s+)?guide|guide\s+to|complete\s+guide)"
)

# --- fixed values: page and URL patterns -------------------------------------
CHAPTER_PREFIX_RE = r"(?i)^(chapter|ch\.?|episode|ep\.?)\s*"
NUMBER_RE = r"-?\d+(?:\.\d+)?"
SPECIAL_RE = r"(?i)(prologue|bonus|extra|special|oneshot|one-shot|pilot|omake|side story)"
CHAPTER_URL_RE = r"(?i)(?:/|-)chapter[-_/ ]?\d+|\bc\d+(?:\.\d+)?\b|(?:/|-)ep(?:isode)?[-_/ ]?\d+"
CHAPTER_TEXT_RE = r"(?i)\b(chapter|ch\.?|episode|ep\.?|prologue|oneshot|one-shot)\b"
CHAPTER_ONE_RE = r"(?i)\b(?:chapter|ch\.?|episode|ep\.?)\s*0*1(?:\.0+)?\b"
CHAPTER_PATH_RE = r"(?i)/(chapter[s]?|episode[s]?|ep)[-_/]?\d"
CHAPTER_SLUG_RE = r"(?i)-chapter-\d|/c\d{1,4}(?:[._-]|$)"
SERIES_PATH_RE = r"(?i)/(manga|manhwa|manhua|comic|series|titles?|title)/"
ARTICLE_PATH_RE = r"(?i)/(blogs?|posts?|articles?|news|guide|review|wiki|about|faq|help)/"
TAXONOMY_PATH_RE = r"(?i)/(tag|genre|category|author|artists?)/"
LOGIN_URL_RE = r"(?i)/(login|signin|register)(/|$|\?)"
GATE_TEXT_RE = r"(?i)(login|sign in|register|create account).{0,40}(to read|to continue|to view)"
IMAGE_BLACKLIST_RE = r"(?i)(?:^|[/._-])(logo|avatar|icon|banner|sprite|thumb|cover|ads?)(?:[/._-]|$)"
IMAGE_EXT_RE = r"(?i)\.(jpg|jpeg|png|webp|gif|avif)(\?|$)"
IMAGE_PATH_RE = r"(?i)/(image|images|uploads?)\b"
SCRIPT_IMAGE_RE = r"(?i)https?://[^\"'\s<>]+\.(?:jpg|jpeg|png|webp|gif|avif)(?:\?[^\"'\s<>]*)?"
SCRIPT_ESCAPED_IMAGE_RE = r"(?i)https?:\\/\\/[^\"'\s<>]+\.(?:jpg|jpeg|png|webp|gif|avif)(?:\?[^\"'\s<>]*)?"
CHAPTER_SEGMENT_TAIL_RE = (
    r"(?i)(?:-|_| )?(?:chapter|chap|ch|episode|ep|c)[-_ ]*\d+(?:\.\d+)?(?:[-_ ]?(?:v|p)\d+)?$"
)
CHAPTER_TOKEN_RE = r"(?i)(?:chapter|chap|ch|episode|ep|c)[-_ ]*\d+(?:\.\d+)?"
CHAPTER_PARAM_RE = r"(?i)(chapter|chap|ch|episode|ep|c)"
HOST_PREFIX_RE = r"(?i)^(www\d*|www|m|mobile|read)\."
SERIES_ROOTS = ["manga", "manhwa", "manhua", "comic", "series", "title", "titles"]
CHAPTER_ROOTS = ["chapter", "chapters", "viewer", "read", "episode", "episodes"]
SERIES_QUERY_KEYS = ["title_no", "series", "manga", "comic", "id"]
IMAGE_ATTRIBUTES = ["data-src", "data-original", "data-lazy-src", "data-url", "data-srcset", "srcset", "src"]

# --- fixed values: evaluation templates --------------------------------------
SEMANTIC_TEMPLATES = [
    "manga or anime about {clue}", "series where {clue}", "story with this vibe: {clue}", "what title is about {clue}",
]
KEYWORD_TEMPLATES = ["{name}", "series with character {name}", "find title for {name}"]
SUITE_TEMPLATES = {
    "semantic": [
        "Find a manga or anime about {descriptor}.", "What is the title where {descriptor}?",
        "I want something with this vibe: {descriptor}.", "Resolve this story to a title: {descriptor}.",
        "Name the series about {descriptor}.",
    ],
    "keyword": [
        "Series with character {keyword}.", "Find title: {title}.", "Which manga features {keyword}?",
        "I want {title}.", "Show me info about {title}.",
    ],
    "cache_hit": [
        "{title}", "Please fetch {title}.", "Exact title lookup: {title}", "{title} manga", "MAL lookup {title}",
    ],
}

# --- fixed values: thresholds and sizes --------------------------------------
TITLE_MATCH = 0.88
TITLE_NEAR = 0.935
TOP_K = 10
POOL = 30
CHARACTER_POOL = 80
ALPHA_DEFAULT, ALPHA_CHARACTER, ALPHA_SHORT = 0.35, 0.12, 0.60
BM25_K1, BM25_B = 1.2, 0.75
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
LISTING_MATCH = 0.58
ALIAS_CANDIDATE_MIN = 0.72
SOURCE_LABEL = "MAL-ID"

# Chapter lists of particular sites (fixed values).
GRID_SELECTOR = r"div.grid.grid-cols-2.gap-3.justify-items-center.lg\:grid-cols-3"
ITEM_SELECTOR = "ol[role='list'][aria-label='List of chapters'] li[role='listitem']"
ITEM_TITLE_SELECTOR = "span.truncate.flex-1"
CHAPTERS_PATH_RE = r"(?i)/chapters/"
FULL_LIST_URL_RE = r"(?i)/full-chapter-list(?:[?#]|$)"
PREVIEW_HOST_RE = r"manhwazone\.com$"
PREVIEW_PATH_RE = r"(?i)^https?://[^/?#]+/preview/"
