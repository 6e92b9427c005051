"""Fixed values of the extraction rules: patterns, word lists, tag sets and thresholds. The same values serve the SQL expressions and the tree operators."""

from __future__ import annotations

# Thresholds -----------------------------------------------------------------------------------------------------
CHAR_THRESHOLD = 500
MIN_SCORED_BYTES = 25
LENGTH_DIVISOR, MAX_LENGTH_BONUS = 100.0, 3.0
SIBLING_SHARE, MIN_SIBLING_SCORE = 0.2, 10.0
PARAGRAPH_BYTES, PARAGRAPH_LINK_DENSITY = 80, 0.25
ANCESTORS = 6
MIN_COMMAS = 10
MIN_EMBED_BYTES = 75
TITLE_SIMILARITY = 0.75
LIST_LINK_DENSITY = 0.5
LOW_LINK_DENSITY, HIGH_LINK_DENSITY, LOW_WEIGHT = 0.2, 0.5, 25
HEADING_DENSITY = 0.9
DATA_TABLE_ROWS, DATA_TABLE_COLUMNS, DATA_TABLE_CELLS = 3, 2, 10
TABLE_NESTING, NAV_TABLE_DENSITY, LAYOUT_TABLE_TEXT = 2, 0.8, 50
CLASS_WEIGHT = 25
HASH_LINK_SHARE = 0.3
WORDS_A_MINUTE = 225
TIMEOUT_S = 30.0
MIN_LIST_TEXT = 80

# Tag sets -------------------------------------------------------------------------------------------------------
TAGS_TO_SCORE = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
BLOCK_IN_DIV = frozenset("blockquote dl div img ol p pre table ul".split())
PHRASING = frozenset(
    "abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark math meter noscript object output progress q "
    "ruby samp script select small span strong sub sup textarea time var wbr".split()
)
INITIAL_SCORES = {
    "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
    "address": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "form": -3.0,
    "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0,
}
UNLIKELY_ROLES = ("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog")
PRESENTATIONAL = ("align", "background", "bgcolor", "border", "cellpadding", "cellspacing", "frame", "hspace", "rules", "style", "valign", "vspace")
SIZED_ELEMENTS = frozenset("table th td hr pre".split())
KEPT_CLASSES = ("page",)

# Patterns; they are case-sensitive and unanchored, and mean the same to Java, RE2 and Python ------------------------
UNLIKELY = "-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|nav|navigation|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
MAYBE = "and|article|body|column|content|main|shadow"
POSITIVE = "article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = "-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
BYLINE = "byline|author|dateline|writtenby|p-author"
SHARE = r"(\b|_)(share|sharedaddy)(\b|_)"
VIDEOS = r"//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"
ARTICLE_TYPES = "^Article|AdvertiserContentArticle|NewsArticle|AnalysisNewsArticle|AskPublicNewsArticle|BackgroundNewsArticle|OpinionNewsArticle|ReportageNewsArticle|ReviewNewsArticle|Report|SatiricalArticle|ScholarlyArticle|MedicalScholarlyArticle|SocialMediaPosting|BlogPosting|LiveBlogPosting|DiscussionForumPosting|TechArticle|APIReference$"
TITLE_SEPARATORS = r" [|\-\\/>»] "

# Word lists -----------------------------------------------------------------------------------------------------
IMPORTANT_LINKS = (
    "more information", "more info", "read more", "continue reading", "learn more", "see more", "view more", "read full", "full article",
    "full story", "continue", "click for more", "view article", "see also", "related article", "more on this",
)
CONTENT_WORDS = ("article", "content", "entry", "hentry", "main", "page", "pagination", "post", "text", "blog", "story", "body", "section", "readable")
NON_CONTENT_WORDS = (
    "combx", "comment", "com-", "contact", "foot", "footer", "footnote", "masthead", "media", "meta", "outbrain", "promo", "related", "scroll", "shoutbox",
    "sidebar", "sponsor", "shopping", "tags", "tool", "widget", "nav", "menu", "header", "ad", "advertisement", "banner", "social", "share", "sharing",
    "login", "signup",
)
NAV_TABLE_WORDS = ("nav", "menu", "header", "sidebar", "topbar")
LAYOUT_TABLE_WORDS = ("layout", "grid", "wrapper", "container", "outer", "inner")
DATA_TABLE_WORDS = ("data", "stats", "statistics", "results", "info")
DATA_TABLE_TAGS = frozenset("col colgroup tfoot thead th".split())
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "Jr.", "Sr.")
DECORATIVE_IMAGES = (
    "spacer", "pixel", "transparent", "blank", "dot", "separator", "icon", "logo", "avatar", "button", "banner", "ad", "advertisement", "tracking", "analytics",
    "pixel.gif", "1x1", "1px", "badge",
)
GENERIC_ALT = ("image", "picture", "photo", "img", "graphic", "icon", "logo", "button", "banner", "thumbnail", "placeholder", "spacer")
#: Areas of content that make an image relevant: tags, parts of a class or identifier, whole classes; and classes of backgrounds.
IMAGE_AREA_TAGS, IMAGE_AREA_PART, IMAGE_AREA_CLASSES, BACKGROUND_CLASSES = ("article", "main"), "content", ("post", "entry"), ("bg", "background")
CONTENT_TYPES = ("Unknown", "Reference", "Article", "Technical", "Error", "Minimal", "Paywall")

# Characters -----------------------------------------------------------------------------------------------------
#: Signs and their plain writing, applied after compatibility composition.
REPLACEMENTS = {
    "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "\u00ad": "", "•": "*", "‣": "*", "⁃": "*", "−": "-", "·": "*", "°": "degrees",
    "®": "(R)", "©": "(C)", "¢": "c", "£": "GBP", "¥": "JPY", "€": "EUR", "÷": "/", "×": "x",
}
#: Names of entities and what they stand for.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "cent": "¢", "pound": "£", "yen": "¥", "euro": "€", "copy": "©", "reg": "®",
    "trade": "™", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"', "bull": "•", "middot": "·",
    "plusmn": "±", "times": "×", "divide": "÷", "not": "¬", "micro": "µ", "para": "¶", "degree": "°", "frac14": "¼", "frac12": "½", "frac34": "¾",
    "iquest": "¿", "iexcl": "¡", "szlig": "ß", "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ",
    "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ",
    "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "oslash": "ø", "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü",
    "yacute": "ý", "yuml": "ÿ", "thorn": "þ", "eth": "ð",
}
BASIC_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
