"""Fixed values of the formats this package reads and writes.

Everything here is data that the results depend on: character classes, line patterns,
element names and lookup tables. The logic that uses them lives elsewhere.
"""

# --- character classes -----------------------------------------------------------------
# White space and line ends as the wiki formats define them (wider than Java's \s).
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
LINE_END_CHARS = "\n\r\u2028\u2029"
BLANK_CHARS = "".join(ch for ch in WS_CHARS if ch not in LINE_END_CHARS)


def members(chars: str) -> str:
    """What stands in a class of ``chars``: neighbours beyond Latin-1 as ranges.

    The matcher tests Latin-1 members by one look-up and all others one after the other, for each
    character of a text, so a list of them is as slow as it is long.
    """
    out, wide = "".join(ch for ch in chars if ch < "\u0100"), sorted(ord(ch) for ch in chars if ch >= "\u0100")
    while wide:
        n = next((n for n, cp in enumerate(wide) if cp != wide[0] + n), len(wide))
        out += chr(wide[0]) if n == 1 else f"{chr(wide[0])}-{chr(wide[n - 1])}"
        wide = wide[n:]
    return out


WS = f"[{members(WS_CHARS)}]"
NOT_WS = f"[^{members(WS_CHARS)}]"
BLANK = f"[{members(BLANK_CHARS)}]"  # white space inside one line
LINE_WS = "[" + members(WS_CHARS.replace("\n", "")) + "]"  # the same for lines cut at "\n" only
ANY = f"[^{LINE_END_CHARS}]"  # any character of one line

# Line boundaries as look-arounds: BOL/EOL for text cut at "\n" only, M_BOL/M_EOL where every
# line end counts. Loops over groups are always possessive and lazy loops run over one
# character class, so the matcher never recurses on long texts.
BOL = r"(?<![^\n])"
EOL = r"(?![^\n])"
M_BOL = f"(?<![^{LINE_END_CHARS}])"
M_EOL = f"(?![^{LINE_END_CHARS}])"



def up_to(end: str) -> str:
    r"""Any text up to the first ``end``, which must start with a literal character.

    Says the same as a lazy ``[\s\S]*?`` in front of ``end`` but steps from one candidate to the
    next instead of trying every character.
    """
    first = end[0]
    return rf"[^{first}]*+(?:(?!{end}){first}[^{first}]*+)*+"


# --- links -----------------------------------------------------------------------------
PSEUDO_SCHEME = "confluence:"
SPACE_PAGE_PATH = r"/spaces/([^/]+)/pages/(\d+)"
DISPLAY_PATH = r"/display/([^/]+)/([^/]+)"
DISPLAY_HREF_PATH = r"/display/([^/]+)/([^/?#]+)"
ANY_PAGE_PATH = r"/pages/(\d+)"
TINY_PATH = r"/x/([^/]+)"
CLOUD_HOST = r"(?i)\.atlassian\.net$"
CLOUD_BASE = "/wiki"

HTML_ANCHOR = (
    r"(?is)<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>"
    rf"({up_to('</a')})</a\s*>"
)
HTML_IMAGE = r"(?i)<img\b[^>]*>"
MD_TARGET = r"\]\(([^()\s]+)\)"
MD_SCANNED_TARGET = r"\]\((confluence:[^()\s]+|/[^()\s]+)\)"
MD_ANCHOR_TARGET = r"\]\(#([^()\s]+)\)"
MD_FILE_LINK = r"\[([^\]]*)\]\(([^()\s]+\.md)\)"

# --- Markdown lines --------------------------------------------------------------------
TOGGLE_FENCE = r"[ \t]*(?:```|~~~)"
HEADING_LINE = r"#{1,6}[ \t]+"
PART_ROW = r"^[ \t]*(?:\d+[.)]|[-*])[ \t]+\[([^\]]*)\]\(([^()\s]+\.md)\)[ \t]*$"
FRONT_MATTER = r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n?"
PART_FRONT_MATTER = r"\A---\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)"

# A closed fenced block: opener at column 0, closer of the same character and at least the
# same length with nothing behind it. An opener without closer is ordinary text.
CODE_BLOCK = "|".join(
    f"{BOL}({ch}{{3,}}+){ANY}*+{EOL}(?:\\n(?!\\{group}{ch}*+{BLANK}*+{EOL})[^\\n]*+)*+"
    f"\\n\\{group}{ch}*+{BLANK}*+{EOL}"
    for group, ch in ((1, "`"), (2, "~"))
)
SAMPLE_HEADING = (
    f"{BOL}(?:#{{1,6}}{LINE_WS}+({ANY}+?){LINE_WS}*#*{EOL}|\\*\\*({ANY}+?)\\*\\*{EOL})"
)
LONG_BLOCK_LINES = 30
APPENDIX_HEADING = "Additional materials"
APPENDIX_NOTE = (
    "<!-- appendix: full-length reference examples, extracted to separate files;"
    " open them only when the examples in the main content are not enough -->"
)
SAMPLE_EXTENSIONS = {
    "xml": "xml",
    "html": "html",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "sql": "sql",
    "java": "java",
    "js": "js",
    "javascript": "js",
    "ts": "ts",
    "typescript": "ts",
    "python": "py",
    "py": "py",
    "sh": "sh",
    "bash": "sh",
}
DEFAULT_EXTENSION = "txt"

# --- document types, first match wins ----------------------------------------------------
VIEW_BULLET = f"{M_BOL}- \\*\\*{ANY}+\\*\\* \\(`[^`]+`\\)"
VIEW_TITLE_LINE = f"{M_BOL}# UI: "
VIEW_TITLE = "^UI: "
VIEW_SECTION = f"{M_BOL}## (\\d+\\. )?View structure{M_EOL}"
MAPPING_SECTION = f"{M_BOL}## Field mappings{M_EOL}"
MAPPING_TITLE_LINE = f"{M_BOL}# Mapping: "
MAPPING_TITLE = "^Mapping: "
CONTRACT_SECTION = f"{M_BOL}## Data model{M_EOL}"
CONTRACT_OPERATIONS = f"{M_BOL}## (Endpoints|Operations|Main elements){M_EOL}"
CONTRACT_TABLE = r"\| Format \|"
DOC_TYPES = {
    "view": "view-design",
    "mapping": "field-mapping",
    "contract": "contract",
    "plain": "confluence-page",
}
BINDING_KEY = "confluence:"

# --- page markup -----------------------------------------------------------------------
MACRO_CODE = rf"""<ac:structured-macro[^>]*ac:name="code"[^>]*>({up_to('</ac:structured-macro>')})</ac:structured-macro>"""
# "/>" closes the macro on the spot; only a macro left open runs to its closing tag.
MACRO_DROPPED = (
    r'<ac:structured-macro[^>]*ac:name="(?:toc|anchor|children|pagetree)"'
    rf"(?:[^>]*/>|[^>]*>{up_to('</ac:structured-macro>')}</ac:structured-macro>)"
)
MACRO_PANEL = (
    r'<ac:structured-macro[^>]*ac:name="(info|note|warning|tip|panel)"[^>]*>'
    rf"({up_to('</ac:structured-macro>')})</ac:structured-macro>"
)
MACRO_STATUS = rf"""<ac:structured-macro[^>]*ac:name="status"[^>]*>({up_to('</ac:structured-macro>')})</ac:structured-macro>"""
MACRO_OTHER = rf"<ac:structured-macro[^>]*>({up_to('</ac:structured-macro>')})</ac:structured-macro>"
MACRO_LANGUAGE = rf"""<ac:parameter[^>]*ac:name="language"[^>]*>({up_to('</ac:parameter>')})</ac:parameter>"""
MACRO_TITLE = rf"""<ac:parameter[^>]*ac:name="title"[^>]*>({up_to('</ac:parameter>')})</ac:parameter>"""
PLAIN_BODY = rf"<ac:plain-text-body>({up_to('</ac:plain-text-body>')})</ac:plain-text-body>"
RICH_BODY = rf"<ac:rich-text-body>({up_to('</ac:rich-text-body>')})</ac:rich-text-body>"
CDATA = rf"<!\[CDATA\[([^\]]*+(?:(?!\]\]>)\][^\]]*+)*+)\]\]>"
TASK_LIST = rf"<ac:task-list>({up_to('</ac:task-list>')})</ac:task-list>"
TASK = rf"<ac:task>({up_to('</ac:task>')})</ac:task>"
TASK_BODY = rf"<ac:task-body>({up_to('</ac:task-body>')})</ac:task-body>"
TASK_DONE = "<ac:task-status>complete</ac:task-status>"
PAGE_LINK = rf"<ac:link[^>]*>({up_to('</ac:link>')})</ac:link>"
PAGE_LINK_TARGET = r"<ri:page[^>]*/?>"
PAGE_LINK_LABEL = rf"<ac:(?:plain-text-)?link-body>({up_to('</ac:(?:plain-text-)?link-body>')})</ac:(?:plain-text-)?link-body>"
USER_TARGET = r"<ri:user[^>]*/?>"
STORAGE_IMAGE = rf"<ac:image[^>]*>({up_to('</ac:image>')})</ac:image>"
ATTACHMENT_TARGET = r"<ri:attachment[^>]*/?>"
URL_TARGET = r"<ri:url[^>]*/?>"
LEFTOVER_TAG = r"</?(?:ac|ri):[a-zA-Z-]+[^<>]*>"
PANEL_CLASS = "confluence-information-macro"
TASK_LIST_CLASS = "inline-task-list"

STYLE = rf"(?i)<style\b[^>]*>{up_to('</style>')}</style>"
SCRIPT = rf"(?i)<script\b[^>]*>{up_to('</script>')}</script>"
ISSUE_TABLE = rf"""(?i)<table\b[^>]*class="[^"]*\bjira-issues\b[^"]*"[^>]*>({up_to('</table>')})</table>"""
TABLE_ROW = rf"(?i)<tr\b[^>]*>({up_to('</tr>')})</tr>"
TABLE_HEADER_CELL = r"(?i)<th\b"
TABLE_CELL = rf"(?i)<td\b[^>]*>({up_to('</td>')})</td>"
COLGROUP = rf"(?i)<colgroup\b[^>]*>{up_to('</colgroup>')}</colgroup>"
COLGROUP_EMPTY = r"(?i)<colgroup\b[^>]*/>"
STATUS_SPAN = r'(?i)<span\b([^>]*\bclass="[^"]*\bjira-status\b[^"]*"[^>]*)>'
ANY_CELL = rf"(?i)<t[hd]\b[^>]*>{up_to('</t[hd]>')}</t[hd]>"
CELL_HEADING = r"(?i)</?h[1-6]\b[^>]*>"
CODE_LANGUAGE = r'(?i)\bdata-code-language="([^"]*)"'
CODE_BRUSH = r'(?i)\bdata-syntaxhighlighter-params="[^"]*?brush:\s*([\w#+-]+)'

# Named entities. "&amp;" must come last.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&amp;": "&",
}
# What a browser's text has beyond that, as far as wiki pages use it.
PAGE_ENTITIES = {
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&ndash;": "–",
    "&mdash;": "—",
    "&hellip;": "…",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&amp;": "&",
}
HTML_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}

# Elements that start and end blocks of text; all others are inline.
BLOCK_ELEMENTS = (
    "address article aside blockquote body caption center dd div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav noscript ol p pre section "
    "table tbody td tfoot th thead tr ul"
).split()
BLOCK_BOUNDARY = "(?i)(?=</?(?:" + "|".join(BLOCK_ELEMENTS) + r")(?![\w-]))"
# The first character of a block tag that is not the first one of the text.
BLOCK_INSIDE = r"(?i)<(?<!\A<)(?=/?(?:" + "|".join(BLOCK_ELEMENTS) + r")(?![\w-]))"
# Everything inside is code, tags too.
PREFORMATTED = rf"(?i)(<pre\b[^>]*>)({up_to('</pre>')})</pre>"
COMMENT = r"<!--[\s\S]*?-->|<![a-zA-Z][^>]*>"
LIST_START = r"""(?i)\sstart\s*=\s*["']?([0-9]{1,8})(?![0-9])"""
BULLET = "-   "
NESTING = "    "
RULE = "---"

# --- Markdown to page markup -------------------------------------------------------------
# Whole lines with their line end. Loops over lines are possessive, so they neither go back nor recurse.
_END = r"(?:\n|\z)"
_BLANK_LINE = r"[ \t]*+\n"
_FULL_LINE = rf"[ \t]*+[^ \t\n][^\n]*+{_END}"
_IN4 = r"(?: {4}| {0,3}\t)"
_IN2 = r"(?: {2}| ?\t)"
# A fence may be indented by up to three blanks; without a closer it runs to the end.
MD_FENCE_START = rf" {{0,3}}(?:`{{3,}}+[^`\n]*+{_END}|~{{3,}})"
MD_FENCE = "|".join(
    f" {{0,3}}({ch}{{3,}}+){info}*+"
    f"(?:\\n(?! {{0,3}}\\{number}{ch}*+[ \\t]*+{_END})[^\\n]*+)*+"
    f"(?:\\n {{0,3}}\\{number}{ch}*+[ \\t]*+)?+{_END}"
    for number, ch, info in ((1, "`", "[^`\\n]"), (2, "~", "[^\\n]"))
)
MD_HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
MD_HEADING_LINE = rf" {{0,3}}#{{1,6}}(?:[ \t][^\n]*+)?{_END}"
MD_RULE_LINE = rf" {{0,3}}(?:(?:-[ \t]*+){{3,}}+|(?:\*[ \t]*+){{3,}}+|(?:_[ \t]*+){{3,}}+){_END}"
MD_ITEM_HEAD = rf"(?!{MD_RULE_LINE}) {{0,3}}(?:[-*+]|[0-9]{{1,9}}[.)])(?=[ \t\n]|\z)"
_BULLET_HEAD = rf"(?!{MD_RULE_LINE}) {{0,3}}[-*+](?=[ \t\n]|\z)"
_NUMBER_HEAD = r" {0,3}[0-9]{1,9}[.)](?=[ \t\n]|\z)"
MD_ITEM_START = r"\A *([-*+]|[0-9]{1,9}[.)])([ ]*)"
_UNDERLINE = rf" {{0,3}}(?:=++|-++)[ \t]*+{_END}"
MD_SETEXT = r"\n {0,3}(=++|-++)[ \t]*+\n?\z"
_RULE_CELL = r"[ \t]*+:?-++:?[ \t]*+"
MD_TABLE = (
    rf"[^|\n]*+\|[^\n]*+\n {{0,3}}(?:\|{_RULE_CELL}(?:\|{_RULE_CELL})*+\|?|{_RULE_CELL}(?:\|{_RULE_CELL})++\|?)[ \t]*+{_END}"
)
_STARTS = rf"(?:{MD_HEADING_LINE}| {{0,3}}>|{MD_FENCE_START}|{MD_RULE_LINE}"
_NO_LAZY = rf"{_STARTS}|{MD_ITEM_HEAD})"
_NO_MORE = rf"{_STARTS}| {{0,3}}(?:[-*+]|1[.)])[ \t]++[^ \t\n]|{MD_TABLE}|{_UNDERLINE})"
_INNER_LINE = rf"{_IN2}{_FULL_LINE}"
_LAZY_LINE = rf"(?!{_NO_LAZY}){_FULL_LINE}"
_GAP = rf"(?:{_BLANK_LINE})++"
# Blank lines, code, headings, rules, quotes, lists, tables and paragraphs: the first that fits.
MD_BLOCK = "|".join(
    (
        MD_FENCE,
        _GAP,
        r"[ \t]++\z",
        rf"(?:{_IN4}{_FULL_LINE}(?:{_GAP}(?={_IN4}{_FULL_LINE}))?+)++",
        MD_HEADING_LINE,
        MD_RULE_LINE,
        rf"(?: {{0,3}}>(?:[ \t]*+{_END}|{_FULL_LINE}(?:{_LAZY_LINE})*+))++",
        *(
            rf"{head}[^\n]*+{_END}(?:{_INNER_LINE}|{head}[^\n]*+{_END}|{_LAZY_LINE}|{_GAP}(?={_INNER_LINE}|{head}))*+"
            for head in (_BULLET_HEAD, _NUMBER_HEAD)
        ),
        rf"{MD_TABLE}(?:{_LAZY_LINE})*+",
        rf"{_FULL_LINE}(?:(?!{_NO_MORE}){_FULL_LINE})*+(?:{_UNDERLINE})?+",
    )
)
# An item of a list whose markers stand at the line start or one blank behind it.
_ITEM_BEGIN = r" ?(?:[-*+]|[0-9]{1,9}[.)])(?=[ \t\n]|\z)"
MD_LIST_ITEM = rf"{_ITEM_BEGIN}[^\n]*+(?:\n(?!{_ITEM_BEGIN})[^\n]*+)*+(?:\n|\z)"
# Noncharacters that stand for others while rules are applied: finished markup is hidden from later
# rules, and runs of inline text are marked. Texts that hold them are escaped before and after.
GUARDED_CHARS = "*_~[]`!(\\<>&\":"
GUARDS = "".join(chr(0xFDD0 + i) for i in range(len(GUARDED_CHARS)))
LABEL_START, LABEL_END = "\ufde1", "\ufde2"
_LT, _GT, _QUOTE = (GUARDS[GUARDED_CHARS.index(x)] for x in '<>"')
# Finished markup, which no address, target or title runs into.
_FINISHED = members(f"{_LT}{_GT}{_QUOTE}{LABEL_START}{LABEL_END}")
FINISHED_TAG = f"{_LT}[^{_GT}]*+{_GT}|[{LABEL_START}{LABEL_END}]"
MD_CODE_SPAN = r"(?<!`)(`++)([\s\S]*?[^`])\1(?!`)"
MD_ESCAPE = r"\\[!-/:-@\[-`{-~]"
MD_AUTOLINK = r"<(https?://[^\s<>]*)>"
# A target may be in pointed brackets, hold balanced brackets, and be followed by a title.
_LINK_TARGET = (
    rf"\(\s*(<[^<>\n{_FINISHED}]*>|(?:[^()\s<{_FINISHED}]|\([^()\s{_FINISHED}]*+\))(?:[^()\s{_FINISHED}]++|\([^()\s{_FINISHED}]*+\))*+|)"
    rf"(?:\s++(\"[^\"{_FINISHED}]*+\"|'[^'{_FINISHED}]*+'|\([^(){_FINISHED}]*+\)))?\s*\)"
)
# A box, not the label of a link.
MD_TASK = rf"\A\[([ x])\](?!{_LINK_TARGET}) ?"
MD_IMAGE = rf"!\[([^\]]*+)\]{_LINK_TARGET}"
MD_LINK = rf"\[((?:[^\[\]]++|\[[^\[\]]*+\])*+)\]{_LINK_TARGET}"
# An address ends with a character that is no punctuation, or with a closed bracket.
_ADDRESS_BRACKET = rf"\([^\s()<>\"{_FINISHED}]*+\)"
BARE_URL = (
    rf"(?<![\w/])https?://(?:(?:(?!{_ADDRESS_BRACKET})[?!.,;:'()*])*+"
    rf"(?:{_ADDRESS_BRACKET}|[^\s<>\"?!.,;:'()*`\\{_FINISHED}]++))++"
)
INLINE_MARK = "\ufdde"
RAW_MARK = "\ufde0"
# Runs of the marks of emphasis with the characters before and behind them, and the ends of link labels.
MD_RUN_MARKS = rf"\*++|_++|~++|[{LABEL_START}{LABEL_END}]"
MD_RUN = rf"(?<=(^|[\s\S]))({MD_RUN_MARKS})(?=([\s\S]|\z))"
# Punctuation next to a run; what stands for finished markup counts as such.
MD_RUN_EDGE = rf"[\p{{P}}\p{{S}}{members(GUARDS + LABEL_START + LABEL_END)}]"
MD_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Marks that an entity cannot make.
ENTITY_GUARDED = "*_~[]`!(\\"
# Characters that XML cannot hold.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
MARK_ESCAPE = "\ufdef"
MARKS = "".join(map(chr, range(0xFDD0, 0xFDF0)))
MARK_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
ANY_MARK = f"[{members(MARKS)}]"
