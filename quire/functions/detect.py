"""What a text is, by its name and its content. All are expressions, so they are pushed into the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats by file name extension.
EXTENSIONS = {
    "txt": "txt text", "md": "md markdown mdown mkd mkdn mdwn markdn rmd qmd", "json": "json jsonl ndjson", "docx": "docx docm", "pdf": "pdf",
    "html": "html htm mhtml mht", "csv": "csv tsv", "xlsx": "xlsx xls ods", "odt": "odt", "odp": "odp", "ics": "ics ical", "asciidoc": "adoc asciidoc asc",
    "rst": "rst", "subtitles": "vtt srt", "opml": "opml", "vcard": "vcf vcard", "djot": "djot dj", "textile": "textile", "sqlite": "sqlite sqlite3 db3",
    "ipynb": "ipynb", "msg": "msg", "pptx": "pptx pptm", "doc": "doc", "epub": "epub", "mbox": "mbox", "rtf": "rtf", "eml": "eml",
    "image": "png jpg jpeg gif webp tif tiff bmp avif ico", "metafile": "emf wmf", "svg": "svg",
}
#: Output formats, and the input formats that allow only some of them.
TARGETS = ("docx", "pdf", "md", "txt", "html", "csv", "json", "xlsx", "epub", "revealjs", "azw3", "azw4")
PICTURE_TARGETS = ("docx", "pdf", "html", "epub", "revealjs", "azw3", "azw4")
DRAWING_TARGETS = (*PICTURE_TARGETS, "txt", "md")
#: Signs of Markdown; the bold sign is spelled out for both of its marks.
MARKDOWN = (
    r"(?m)^#{1,6}\s+\S", r"(?m)^\s*[-*+]\s+\S", r"(?m)^\s*\d+\.\s+\S", "```", r"\[[^\]]+\]\([^)]+\)", r"\*\*[^*_]+\*\*|__[^*_]+__",
    r"(?m)^\s*>\s+\S", r"(?m)^\s*\|.+\|\s*$",
)
#: What source code is full of and tables are not.
CODE_TELL = r"[{};]\s*$|\)\s*:\s*$|=>|->|::|//|/\*|\*/|\$\(|\$\{|<\?|\?>|^#(?:include|define|pragma|!)|(?:^|[\s(])(?:def|class|func|function|import|export|return|elif|endif|typedef|struct|namespace|void|public|private|protected|static|const|let|var|require|printf|println|echo)[\s(:]"


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.\\/]+)$", 1))


def format_by_extension(filename: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, exts in EXTENSIONS.items() for e in exts.split() for x in (e, name)))
    return F.try_element_at(known, extension(filename))


def looks_like_markdown(text: Column) -> Column:
    found = F.lit(False)
    for pattern in MARKDOWN:
        found = found | text.rlike(pattern)
    return found


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda l: F.trim(l) != "")


def looks_like_csv(text: Column) -> Column:
    """Two or more filled lines that one delimiter cuts into the same number of fields, two at least."""
    lines = filled_lines(text)

    def even(mark: str) -> Column:
        counts = F.array_distinct(F.transform(lines, lambda l: F.length(l) - F.length(F.replace(l, F.lit(mark), F.lit("")))))
        return (F.size(counts) == 1) & (F.get(counts, F.lit(0)) > 0)

    return (F.size(lines) >= 2) & (even(",") | even(";") | even("\t"))


def looks_like_mail(text: Column) -> Column:
    """Three or more header lines before the first blank line, a sender among them and a receiver, subject or trace."""
    head = F.split(F.regexp_extract(text, r"(?s)^(.*?)(?:\r?\n[ \t]*(?:\r?\n|$)|$)", 1), r"\r?\n")
    headers = F.filter(head, lambda l: l.rlike(r"^[A-Za-z][A-Za-z-]*:\s"))
    return (F.size(headers) >= 3) & F.exists(headers, lambda l: l.rlike("(?i)^From:")) & F.exists(headers, lambda l: l.rlike("(?i)^(To|Subject|Received):"))


def looks_like_mailbox(text: Column) -> Column:
    return text.rlike(r"^From \S+") & text.rlike(r"(?m)^From:\s*\S+") & text.rlike(r"(?m)^(To|Subject|Date):\s*\S+")


def looks_like_vcard(text: Column) -> Column:
    return F.exists(F.slice(F.split(F.substring(text, 1, 1024), r"\r?\n"), 1, 5), lambda l: l.rlike(r"(?i)^\s*BEGIN:VCARD\s*$"))


def looks_like_notebook(text: Column) -> Column:
    v = F.try_parse_json(text)
    array = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.try_variant_get(v, "$.worksheets", "array<variant>"))
    return F.coalesce(F.try_variant_get(v, "$.nbformat", "variant").isNotNull() & array.isNotNull(), F.lit(False))


def text_format(text: Column, filename: Column) -> Column:
    """The format of a text: by extension, else by content; a name is needed for csv."""
    by_name = format_by_extension(filename)
    by_name = F.when((by_name == "vcard") & ~looks_like_vcard(text), "txt").otherwise(by_name)
    return F.coalesce(
        by_name,
        F.when(text.rlike(r"(?m)^BEGIN:VCALENDAR\s*$"), "ics").when(looks_like_vcard(text), "vcard").when(text.rlike(r"^WEBVTT(\s|$)"), "subtitles")
        .when(looks_like_notebook(text), "ipynb").when(looks_like_mailbox(text), "mbox").when(looks_like_mail(text), "eml").when(looks_like_markdown(text), "md")
        .when(filename.isNotNull() & looks_like_csv(text), "csv").otherwise("txt"),
    )


def binary_format(content: Column) -> Column:
    """The format that the first bytes show, or null."""
    head = F.hex(F.substring(content, 1, 16))
    latin = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    zipped = F.when(F.contains(latin, F.lit("mimetypeapplication/epub+zip")), "epub")
    for mime, name in (("text", "odt"), ("spreadsheet", "xlsx"), ("presentation", "odp")):
        zipped = zipped.when(F.contains(latin, F.lit(f"application/vnd.oasis.opendocument.{mime}")), name)
    whole = F.decode(content, "ISO-8859-1")
    for part, name in (("xl/workbook", "xlsx"), ("ppt/presentation", "pptx"), ("word/document", "docx")):
        zipped = zipped.when(F.contains(whole, F.lit(part)), name)
    return (
        F.when(head.startswith("53514C69746520666F726D6174203300"), "sqlite").when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("47494638") | head.startswith("49492A00") | head.startswith("4D4D002A") | head.startswith("424D"), "image")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image").when(head.startswith("255044462D"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "cfb")
        .when(head.startswith("7B5C727466"), "rtf").when(head.startswith("504B0304") | head.startswith("504B0506"), zipped.otherwise("zip"))
    )


def declared_charset(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(html, 1, 1024), r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)", 1))


def blocked_ipv4(address: Column) -> Column:
    """Addresses that no fetch may reach: private, local, shared, reserved or multicast; what is no address is blocked."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("int")))
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    sound = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull() | (p > 255))
    inside = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)) | ((b == 88) & (c == 99)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    return ~F.coalesce(sound & ~inside, F.lit(False))


def unsafe_archive_path(path: Column) -> Column:
    return path.rlike(r"^[/\\]|^[A-Za-z]:") | F.exists(F.split(path, r"[/\\]"), lambda p: p == "..")


#: Sizes of a BMP's info header, and the brands of AVIF and HEIF files.
BMP_HEADERS = (12, 16, 40, 52, 56, 64, 108, 124)
AVIF_BRANDS = ("avif", "avis")
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")


def _hex_at(data: Column, start: int, size: int) -> Column:
    return F.hex(F.substring(data, start + 1, size))


def _brands(data: Column) -> Column:
    """The brands of an ISO media file's first box (null: it has none), from its first 256 bytes."""
    size = F.least(F.conv(_hex_at(data, 0, 4), 16, 10).cast("long"), F.length(data), F.lit(256))
    more = F.when(size >= 20, F.transform(F.sequence(F.lit(16), (size - 4).cast("int"), F.lit(4)), lambda at: F.hex(F.substring(data, at + 1, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    return F.when((F.length(data) >= 16) & (_hex_at(data, 4, 4) == b"ftyp".hex().upper()), F.concat(F.array(_hex_at(data, 8, 4)), more))


def _has_brand(data: Column, brands: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(_brands(data), F.array(*(F.lit(b.encode().hex().upper()) for b in brands))), F.lit(False))


def picture_type(data: Column) -> Column:
    """A picture's MIME type by its signature; null for what is none of the known types."""
    n = F.length(data)
    rules = [
        (n >= 8, _hex_at(data, 0, 4) == "89504E47", "image/png"),
        (n >= 3, _hex_at(data, 0, 3) == "FFD8FF", "image/jpeg"),
        (n >= 6, _hex_at(data, 0, 6).isin("474946383761", "474946383961"), "image/gif"),
        (n >= 12, (_hex_at(data, 0, 4) == "52494646") & (_hex_at(data, 8, 4) == "57454250"), "image/webp"),
        (n >= 26, (_hex_at(data, 0, 2) == "424D") & _hex_at(data, 14, 4).isin(*(k.to_bytes(4, "little").hex().upper() for k in BMP_HEADERS)), "image/bmp"),
        (n >= 16, _has_brand(data, AVIF_BRANDS), "image/avif"),
        (n >= 6, (_hex_at(data, 0, 4) == "00000100") & (_hex_at(data, 4, 2) != "0000"), "image/x-icon"),
        (n >= 8, _hex_at(data, 0, 4).isin("49492A00", "4D4D002A"), "image/tiff"),
        (n >= 88, (_hex_at(data, 0, 4) == "01000000") & (_hex_at(data, 40, 4) == "20454D46"), "image/x-emf"),
        (n >= 22, _hex_at(data, 0, 4) == "D7CDC69A", "image/x-wmf"),
        (n >= 18, _hex_at(data, 0, 2).isin("0100", "0200") & (_hex_at(data, 2, 2) == "0900") & _hex_at(data, 4, 2).isin("0001", "0003"), "image/x-wmf"),
    ]
    return F.coalesce(*(F.when(size & signature, mime) for size, signature, mime in rules))


def is_heic(data: Column) -> Column:
    """A HEIC or HEIF picture, not AVIF, which shares the container."""
    return _has_brand(data, HEIF_BRANDS) & ~_has_brand(data, AVIF_BRANDS)


#: The language of code by a file's extension, and by its whole name.
CODE_LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "sql": "sql", "sh": "bash", "bash": "bash", "ps1": "powershell", "psm1": "powershell", "yaml": "yaml", "yml": "yaml", "toml": "ini", "ini": "ini",
    "json": "json", "jsonc": "json", "json5": "json", "xml": "xml", "xsd": "xml", "xsl": "xml", "xslt": "xml", "csproj": "xml", "config": "xml", "plist": "xml", "css": "css", "scss": "scss", "php": "php", "phtml": "php",
    "swift": "swift", "lua": "lua", "pl": "perl", "pm": "perl", "r": "r", "mm": "objectivec", "vb": "vbnet", "graphql": "graphql", "gql": "graphql", "less": "less", "kts": "kotlin", "wat": "wasm", "scala": "scala",
    "groovy": "groovy", "gradle": "groovy", "dart": "dart", "hs": "haskell", "ex": "elixir", "exs": "elixir", "erl": "erlang", "clj": "clojure", "cljs": "clojure", "fs": "fsharp", "fsx": "fsharp", "ml": "ocaml", "jl": "julia",
    "vbs": "vbscript", "bat": "dos", "cmd": "dos", "cmake": "cmake", "proto": "protobuf", "asm": "x86asm", "s": "x86asm", "env": "ini", "properties": "ini", "conf": "ini", "cfg": "ini", "editorconfig": "ini",
    "gitconfig": "ini", "npmrc": "ini", "diff": "diff", "patch": "diff",
}
CODE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "nginx.conf": "nginx"}


def code_language(filename: Column | str) -> Column:
    """The language of a source file by its name: by the whole name, then settings of an environment (.env and .env.something), then the extension; null for no source file."""
    named = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    base = F.lower(F.regexp_extract(filename, r"([^\\/]*)$", 1))
    settings = F.when(base.rlike(r"^\.env(\.[A-Za-z0-9_-]+)?$"), "ini")
    return F.coalesce(named(CODE_NAMES, base), settings, named(CODE_LANGUAGES, F.regexp_extract(base, r"\.([a-z0-9]+)$", 1)))
