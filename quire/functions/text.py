"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.numbers import luminance
from quire.functions.pictures import let


def github_slug(text: Column) -> Column:
    """The anchor of a heading: lower case, letters, marks, digits, connectors, hyphens; spaces to hyphens."""
    return F.replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))


def csv_cell(value: Column) -> Column:
    """A cell as RFC 4180 quotes it: only where it holds a quote, a comma or a line end."""
    return F.when(value.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def escape_html(value: Column) -> Column:
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(reference))
    return value


def escape_text(value: Column) -> Column:
    """Text as markup, outside of attributes."""
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(raw), F.lit(reference))
    return value


def text_length(html: Column) -> Column:
    """Characters outside tags, scripts and styles, without white space; a character reference counts as one."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", ""), "<[^>]*>", "")
    return F.length(F.regexp_replace(F.regexp_replace(bare, r"&[#\w]+;", "x"), r"\s+", ""))


def dedent(text: Column) -> Column:
    """Lines without the white space that all lines that are not blank share at their start."""
    lines = F.split(text, "\n")
    shared = F.array_min(F.transform(F.filter(lines, lambda l: F.trim(l) != ""), lambda l: F.length(F.regexp_extract(l, r"^[ \t]*", 0))))
    return F.when(shared.isNull(), text).otherwise(F.array_join(F.transform(lines, lambda l: F.substr(l, shared + 1)), "\n"))


def safe_filename(name: Column) -> Column:
    """A name that any file system takes: reserved characters to underscores, no dots or spaces at the end, never empty."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(clean == "", "_").when(F.lower(clean).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"), F.concat(F.lit("_"), clean)).otherwise(clean)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b?\[[0-9;]*m", "")


def cell_boundaries(line: Column) -> Column:
    """Tab-separated fields as text: trimmed, without empty ones, with a bar between."""
    return F.array_join(F.filter(F.transform(F.split(line, "\t"), lambda x: F.trim(x)), lambda x: x != ""), " | ")


def needs_reformat(text: Column) -> Column:
    """A long text on one or two filled lines, or one with a line of over 500 characters."""
    lines = F.split(text, "\n")
    packed = (F.length(text) > 200) & (F.size(F.filter(lines, lambda l: ~l.rlike(r"^\s*$"))) <= 2)
    return packed | F.exists(lines, lambda l: F.length(l) > 500)


def task_item(text: Column) -> Column:
    """A list item that begins with a task box, its box as a character."""
    return F.regexp_replace(F.regexp_replace(text, r"^\[ \] ", "☐ "), r"^\[[xX]\] ", "☑ ")


def split_records(text: Column, size: int = 4096) -> Column:
    """Fixed-size records of a text's bytes."""
    raw = F.encode(text, "UTF-8")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / size).cast("int"))), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def strip_xml_illegal(text: Column) -> Column:
    """Without the characters that XML cannot hold: control characters but tab and line ends, U+FFFE and U+FFFF."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "")


def safe_label(raw: Column) -> Column:
    """A note's label of letters, digits and _.- only, at most 56 characters, never empty; to be made unique by numbering."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(raw), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    short = F.substring(clean, 1, 56)
    return F.when(short == "", "note").otherwise(short)


def sheet_name(raw: Column) -> Column:
    """A sheet's name as workbooks allow it: no []:*?/\\ and at most 31 characters; to be made unique by numbering."""
    clean = F.trim(F.regexp_replace(raw, r"[\[\]:*?/\\]", "_"))
    return F.substring(F.when(clean == "", "Sheet").otherwise(clean), 1, 31)


def contents_entry(line: Column) -> Column:
    """A line of a table of contents, "title ..... 12", as "title — 12"; null for other lines."""
    title, number = F.trim(F.regexp_extract(line, r"^(\S.*?)\s*\.{3,}\s*([0-9]+)$", 1)), F.regexp_extract(line, r"^(\S.*?)\s*\.{3,}\s*([0-9]+)$", 2)
    return F.when((number != "") & (title != ""), F.concat(title, F.lit(" — "), number))


def limit_message(shown: Column, total: Column, noun: str = "records") -> Column:
    return F.concat(F.lit("Showing the first "), F.format_number(shown, 0), F.lit(" of "), F.format_number(total, 0), F.lit(f" {noun}."))


def blob_label(length: Column) -> Column:
    """What a binary value is, without its bytes: "[blob 1.2 KB]"; halves are rounded up."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    size = F.when(length < 1024, F.concat(length.cast("string"), F.lit(" B"))).when(length < 1024 * 1024, F.concat(one(length / 1024), F.lit(" KB"))).otherwise(F.concat(one(length / 1024 / 1024), F.lit(" MB")))
    return F.concat(F.lit("[blob "), size, F.lit("]"))


def yaml_scalar(raw: Column) -> Column:
    """A scalar of YAML: quotes removed and their escapes undone, a comment cut off; null where there is none or a block follows."""
    v = F.trim(raw)
    quoted = lambda q: (F.length(v) >= 2) & v.startswith(q) & v.endswith(q)
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    return (
        F.when((v == "") | v.rlike(r"^[|>][+-]?[0-9]*$"), None).when(quoted("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .when(quoted('"'), F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(F.regexp_replace(v, r"\s+#.*$", ""))
    )


#: The lines that a front-matter block may hold, and the longest block.
FRONT_MATTER_LINE = r"^(?:\s*|#.*|[A-Za-z0-9_][\w .-]*:(?:\s.*)?|[ \t].*|- .*)$"
KEY_LINE = r"^[A-Za-z0-9_][\w .-]*:"
FRONT_MATTER_LINES = 200


def front_matter(text: Column) -> Column:
    """(body, title): a text without the YAML block at its head, if that can be nothing else, and the title that the block names.

    The text is split once, and only as far as a block may reach; what follows stays in one piece."""

    def cut(lines: Column) -> Column:
        ends = F.transform(F.slice(lines, F.lit(2), F.lit(FRONT_MATTER_LINES)), lambda l: F.rtrim(l).isin("---", "..."))
        close = F.when(F.rtrim(F.get(lines, F.lit(0))) == "---", F.array_position(ends, True).cast("int"))  # from 1, after the first line
        return let(close, lambda close: let(F.when(close > 0, F.slice(lines, F.lit(2), close - 1)), lambda block: without(lines, close, block)))

    def without(lines: Column, close: Column, block: Column) -> Column:
        sound = F.coalesce(F.forall(block, lambda l: l.rlike(FRONT_MATTER_LINE)) & F.exists(block, lambda l: l.rlike(KEY_LINE)), F.lit(False))
        title = yaml_scalar(F.substring(F.get(F.filter(block, lambda l: l.startswith("title:")), F.lit(0)), 7, 2**31 - 1))
        # Only the last piece holds line ends.
        body = F.array_join(F.transform(F.slice(lines, close + 2, F.size(lines)), lambda l: F.replace(l, F.lit("\r\n"), F.lit("\n"))), "\n")
        return F.when(sound, F.struct(body.alias("body"), F.nullif(title, F.lit("")).alias("title"))).otherwise(F.struct(text.alias("body"), F.lit(None).cast("string").alias("title")))

    return let(F.split(text, r"\r?\n", FRONT_MATTER_LINES + 2), cut)


#: The constructs of Markdown, two of which make a text Markdown beyond doubt.
CONSTRUCTS = (
    r"(?m)^#{1,6}[ \t]+\S", r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\S", r"\[[^\]\n]+\]\((?:https?:|mailto:|[./#])[^)\s]*\)", r"\*\*[^*\s][^*\n]*\*\*",
    r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|", r"(?m)^>[ \t]",
)
FENCED = (r"(?m)^ {0,3}(?:`{3,}|~{3,})[\w+#.-]+[ \t]*$", r"(?ms)^ {0,3}`{3}[^\n]*\n.*?^ {0,3}`{3}", r"(?ms)^ {0,3}~{3}[^\n]*\n.*?^ {0,3}~{3}")


def clearly_markdown(text: Column) -> Column:
    """A fenced block, or two different constructs of Markdown."""
    fenced = F.lit(False)
    for pattern in FENCED:
        fenced = fenced | text.rlike(pattern)
    count = F.lit(0)
    for pattern in CONSTRUCTS:
        count = count + text.rlike(pattern).cast("int")
    return fenced | (count >= 2)


def auto_tables(html: Column, most_rows: int = 500, longest: int = 28) -> Column:
    """Whether a document's tables are few enough in rows, and short enough in words, to be laid out by their content."""
    rows = F.size(F.regexp_extract_all(html, F.lit(r"<tr[\s>]"), F.lit(0)))
    tables = F.regexp_extract_all(html, F.lit(r"(?s)<table[\s>].*?</table>"), F.lit(0))
    bare = F.transform(tables, lambda t: F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"&[#\w]+;", "x"))
    return (rows <= most_rows) & ~F.exists(bare, lambda t: F.exists(F.split(t, r"\s+"), lambda w: F.length(w) > longest))


def tab_rows(block: Column, code_tell: str) -> Column:
    """A block of lines as rows of cells at its tabs; null unless all of two lines or more have the same two or more fields, begin with text and look like no code."""
    lines = F.filter(F.split(block, "\n"), lambda l: F.trim(l) != "")
    rows = F.transform(lines, lambda l: F.transform(F.split(F.regexp_replace(l, r"\s+$", ""), "\t"), lambda f: F.regexp_replace(f, r"^\s+|\s+$", "")))
    plain = F.forall(lines, lambda l: l.rlike(r"^[^\t]*[^\t\s][^\t]*\t") & ~l.rlike(code_tell))
    even = F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) == 1
    return F.when((F.size(lines) >= 2) & plain & even & (F.size(F.get(rows, F.lit(0))) >= 2), rows)


def language_from_class(css: Column, languages: dict[str, str], markers: tuple[str, ...] = ("sourcecode", "hljs", "prettyprint", "highlight", "code", "codehilite", "syntax")) -> Column:
    """The code language that a class attribute names, by `languages` (lower-case alias to language).

    A `brush:` decides alone; then the first token with a prefix that names one, whole or up to its first hyphen; then, beside a marker, the first token that is one.
    """
    known = F.create_map(*(F.lit(x) for pair in languages.items() for x in pair))
    named = lambda x: known[F.lower(x)]
    prefix = "(?i)^(?:language-|lang-|highlight-source-|highlight-text-|highlight-)(.+)$"
    tokens = F.filter(F.split(css, r"\s+"), lambda t: t != "")
    spelled = F.transform(tokens, lambda t: F.regexp_extract(t, prefix, 1))
    prefixed = F.get(F.filter(F.transform(spelled, lambda s: F.when(s != "", F.coalesce(named(s), named(F.split(s, "-")[0])))), lambda x: x.isNotNull()), F.lit(0))
    is_marker = lambda t: F.lower(t).isin(*markers)
    bare = F.when(F.exists(tokens, is_marker), F.get(F.filter(F.transform(F.filter(tokens, lambda t: ~is_marker(t)), named), lambda x: x.isNotNull()), F.lit(0)))
    brush = F.regexp_extract(css, r"(?i)\bbrush:\s*([\w+#-]+)", 1)
    return F.when(brush != "", named(brush)).otherwise(F.coalesce(prefixed, bare))


def resolvable_links(html: Column) -> Column:
    """html whose links that lead to no web page or mail address are unwrapped; their text stays."""
    return F.regexp_replace(html, r"""(?is)<a\b(?!(?:(?!\bhref=")[^>])*\bhref="(?:https?|mailto):)[^>]*>(.*?)</a>""", "$1")


#: The elements that may stand around a picture that is all of a document.
PICTURE_WRAPPERS = ("p", "div", "span", "a", "figure", "picture", "center", "section", "article", "main", "br")


def lone_picture(html: Column) -> Column:
    """Whether html is one picture and nothing else but comments, wrappers and white space."""
    rest = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?i)<img\b[^>]*>", "")
    tags = F.regexp_extract_all(rest, F.lit(r"(?i)</?([a-z][\w-]*)"), 1)
    bare = F.regexp_replace(F.regexp_replace(rest, "<[^>]*>", ""), r"(?i)&nbsp;|&#160;|&#xa0;|\s", "")
    return (F.regexp_count(html, F.lit(r"(?i)<img\b[^>]*>")) == 1) & F.forall(tags, lambda t: F.lower(t).isin(*PICTURE_WRAPPERS)) & (bare == "")


def picture_pages(html: Column) -> Column:
    """The width and height attributes (double) of each picture of a document that is pictures with rules between them (null where a picture lacks one); null for any other document."""
    parts = F.split(html, r"(?i)<hr\b[^>]*>", -1)
    size = lambda part, name: F.regexp_extract(part, rf"""(?is)<img\b[^>]*?\s{name}\s*=\s*["']?\s*([0-9.]+)(?:px)?\s*["'\s>/]""", 1).try_cast("double")
    both = lambda part: F.when((size(part, "width") > 0) & (size(part, "height") > 0), F.struct(size(part, "width").alias("width"), size(part, "height").alias("height")))
    return F.when(F.forall(parts, lone_picture), F.transform(parts, both))


#: The labels of notes, and the classes of code that name a language or mark highlighted code.
NOTE_LABEL = r"^[A-Za-z0-9_.-]{1,64}$"
CODE_CLASS = r"^(?:language-[\w+-]+|hljs)$"
#: The colours of text markers by name.
MARKERS = {
    "yellow": "FFFF00", "lime": "00FF00", "cyan": "00FFFF", "aqua": "00FFFF", "magenta": "FF00FF", "fuchsia": "FF00FF", "blue": "0000FF", "red": "FF0000", "black": "000000", "white": "FFFFFF",
    "navy": "000080", "teal": "008080", "green": "008000", "purple": "800080", "maroon": "800000", "olive": "808000", "gray": "808080", "grey": "808080", "silver": "C0C0C0",
}


def code_class(classes: Column) -> Column:
    """Of the classes of a code element those that name its language or mark it as highlighted; display math stays behind its language. Null for none."""
    given = F.split(F.coalesce(classes, F.lit("")), r"\s+")
    kept = F.filter(given, lambda c: c.rlike(CODE_CLASS))
    shown = F.when(F.array_contains(given, "math-display"), F.array(F.lit("language-math"), F.lit("math-display"))).otherwise(F.array(F.lit("language-math")))
    at = F.array_position(kept, "language-math").cast("int")
    spread = F.when(at > 0, F.concat(F.slice(kept, 1, at - 1), shown, F.slice(kept, at + 1, F.size(kept)))).otherwise(kept)
    return F.when(F.size(kept) > 0, F.array_join(spread, " "))


def colour(word: Column) -> Column:
    """RRGGBB of a colour as #rgb, #rrggbb, rgb(r, g, b) in whole numbers, or the name of a text marker's; null for none."""

    def of(word: Column) -> Column:
        named = F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), word)
        short = F.regexp_replace(F.regexp_extract(word, r"^#([0-9a-f]{3})$", 1), r"(.)", "$1$1")
        long = F.regexp_extract(word, r"^#([0-9a-f]{6})$", 1)
        parts = F.transform(F.array(*[F.regexp_extract(word, r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$", k).try_cast("int") for k in (1, 2, 3)]), lambda n: F.when(n.isNotNull(), F.lpad(F.hex(F.least(n, F.lit(255))), 2, "0")))
        return F.coalesce(named, F.when(short != "", F.upper(short)), F.when(long != "", F.upper(long)), let(parts, lambda p: F.when(F.size(F.array_compact(p)) == 3, F.array_join(p, ""))))

    return let(F.lower(F.trim(word)), of)


def mark_style(style: Column) -> Column:
    """The style of a marker of another colour than yellow, with white text on a dark one; null for a plain marker."""
    own = F.regexp_extract(style, r"(?i)(?:^|;)\s*background-color\s*:\s*([^;]+)", 1)
    words = F.regexp_extract_all(F.regexp_extract(style, r"(?i)(?:^|;)\s*background\s*:\s*([^;]+)", 1), F.lit(r"[^\s(]+\([^)]*\)|[^\s]+"), F.lit(0))
    found = let(own, lambda own: F.when(own != "", colour(own)).otherwise(F.try_element_at(F.array_compact(F.transform(words, colour)), F.lit(-1))))

    def styled(found: Column) -> Column:
        dark = let(luminance(F.concat(F.lit("#"), found)), lambda light: 1.05 / (light + 0.05) > (light + 0.05) / 0.05)
        return F.when(found != "FFFF00", F.concat(F.lit("background-color:#"), found, F.when(dark, ";color:#FFFFFF").otherwise("")))

    return let(found, styled)


def cell_style(style: Column, align: Column) -> Column:
    """The alignment of a cell from its style, else from its attribute, as a style; null for none."""
    said = F.try_element_at(F.regexp_extract_all(style, F.lit(r"(?i)(?:^|;)\s*text-align\s*:\s*([^;]*)"), F.lit(1)), F.lit(-1))
    value = F.lower(F.trim(F.regexp_replace(F.coalesce(said, align), r"(?i)!\s*important\s*$", "")))
    return F.when(value.isin("left", "center", "right"), F.concat(F.lit("text-align:"), value))


#: How speaker notes are marked, and the code that is a diagram or a formula.
NOTES, DIAGRAM, FORMULA = r"<!--\s*notes:", '<pre><code class="language-(?:mermaid|dot)">', '<code class="language-math(?: math-display)?">'


def has_speaker_notes(html: Column | str) -> Column:
    html = F.col(html) if isinstance(html, str) else html
    return html.rlike(f"(?i){NOTES}")


def without_speaker_notes(html: Column | str) -> Column:
    """html without its speaker notes, which may go over many lines."""
    return F.regexp_replace(html, f"(?is){NOTES}.*?-->", "")


def has_diagrams(html: Column) -> Column:
    """Whether a document holds diagrams that have to be drawn."""
    return html.rlike(DIAGRAM)


def has_formulas(html: Column) -> Column:
    return html.rlike(FORMULA)


def blocks(text: Column | str) -> Column:
    """The lines of a plain text that are not blank, whatever its line ends are, in order."""
    return F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda b: F.trim(b) != "")


def data_uri(kind: str, data: Column) -> Column:
    """Bytes as a data address of a kind."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def data_of_uri(uri: Column | str) -> Column:
    """The bytes of a data address in base64; null for any other."""
    return F.unbase64(F.nullif(F.regexp_extract(uri, "(?i)^data:[^,]*;base64,(.*)$", 1), F.lit("")))


def content_key(version: str, *parts: Column | str) -> Column:
    """A key for what is made of some texts by one version of its maker."""
    return F.sha2(F.concat_ws("\n", F.lit(version), *parts), 256)


def clock(seconds: Column | str) -> Column:
    """Seconds as hours, minutes and seconds of two digits, without fractions."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def mail_date(at: Column | str) -> Column:
    """A time as the header of a mail has it, in GMT (the session's time zone has to be UTC)."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
