"""Column functions over texts, paths, sizes and times. All run inside Spark's JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a chunk, and how far the next chunk's start is.
CHUNK_WORDS, CHUNK_STEP = 200, 160

# File suffixes by kind, names that are never indexed, what a kind is called.
TEXT_SUFFIXES = [".txt", ".md", ".markdown", ".rst", ".log", ".csv", ".json", ".xml", ".yaml", ".yml", ".html", ".htm", ".ps1", ".sh", ".bat", ".cmd"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".tif", ".tiff"]
DOCUMENT_KINDS = {".pdf": "pdf", ".docx": "docx", ".pptx": "slides", ".xlsx": "spreadsheet", ".ipynb": "notebook"}
MEDIA_SUFFIXES = [".mp3", ".m4a", ".flac", ".ogg", ".opus", ".wav", ".wma", ".mp4", ".mkv", ".mov", ".avi", ".webm"]
BINARY_SUFFIXES = {
    "archive": [".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".jar", ".whl"],
    "executable": [".exe", ".dll", ".msi", ".msix", ".appx", ".apk"],
    "disk-image": [".iso", ".img", ".dmg", ".vhd", ".vhdx"],
    "data": [".parquet"],
    "media": MEDIA_SUFFIXES,
}
COMPOUND_SUFFIXES = [".tar.gz", ".tar.bz2", ".tar.xz"]
IGNORED_STARTS = ["~$", "~", ".tmp", ".crdownload", ".part"]
KIND_NAMES = {"archive": "archive", "executable": "executable installer or application", "disk-image": "disk image", "data": "data file", "media": "audio or video recording"}
INDEXABLE = sorted({*TEXT_SUFFIXES, *IMAGE_SUFFIXES, *DOCUMENT_KINDS, *(s for own in BINARY_SUFFIXES.values() for s in own)})


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and what they are without, by Unicode decomposition; combining marks go."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1:
            pairs.append((chr(code), parts[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_MARKED, _PLAIN = _plain_letters()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def split_words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-cased runs of word characters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w']+"), 0)


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and digits, without case and diacritics."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def chunk_count(n_words: Column) -> Column:
    return F.when(n_words == 0, 0).when(n_words <= CHUNK_WORDS, 1).otherwise(F.ceil((n_words - CHUNK_WORDS) / CHUNK_STEP) + 1).cast("int")


def chunks(own: Column) -> Column:
    """Overlapping windows of a text's words, in order. ``own`` is a column that holds the
    words, not an expression, which would be worked out again for each window."""
    at = F.sequence(F.lit(1), F.greatest(chunk_count(F.size(own)), F.lit(1)))
    made = F.transform(at, lambda i: F.array_join(F.slice(own, (i - 1) * CHUNK_STEP + 1, CHUNK_WORDS), " "))
    return F.when(F.size(own) > 0, made).otherwise(F.array().cast("array<string>"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last suffix of the name, lower-cased, with its dot."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def binary_kind(path: Column) -> Column:
    """Kind of a file that is indexed by name only; null for others."""
    low, own = F.lower(path), suffix(path)
    found = F.when(reduce(Column.__or__, [low.endswith(s) for s in COMPOUND_SUFFIXES]), "archive")
    for kind, suffixes in BINARY_SUFFIXES.items():
        found = found.when(own.isin(suffixes), kind)
    return found


def text_kind(path: Column) -> Column:
    """Kind by suffix of a file whose text is read; ``other`` where there is no reader."""
    found = F.when(suffix(path).isin(TEXT_SUFFIXES), "text")
    for s, kind in DOCUMENT_KINDS.items():
        found = found.when(suffix(path) == s, kind)
    return found.otherwise("other")


def is_cloud_synced(path: Column) -> Column:
    return F.lower(path).rlike("onedrive|dropbox|icloud")


def has_real_text(text: Column, least: int = 20) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= least


def human_size(n: Column, last: str = "TB") -> Column:
    """Bytes in steps of 1024: whole bytes, else one decimal, in no larger unit than ``last``."""
    out, units = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))), ["KB", "MB", "GB", "TB"]
    for k, unit in enumerate(units, 1):
        shown = F.format_string(f"%.1f {unit}", n.cast("double") / 1024**k)
        if unit == last:
            return out.otherwise(shown)
        out = out.when(n < 1024 ** (k + 1), shown)
    raise ValueError(f"no unit {last}")


def duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = seconds.cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def name_tokens(path: Column) -> Column:
    """Parts of a file's name, without its suffix, then the suffix's parts; a dot between digits doesn't split."""
    name = F.lower(base_name(path))
    end = F.when(name.rlike(r"\.tar\.(gz|bz2|xz)$"), F.regexp_extract(name, r"(\.tar\.(?:gz|bz2|xz))$", 1)).otherwise(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(end))
    parts = F.split(stem, r"[-_\s]+|(?<=\D)\.|\.(?=\D)")
    return F.filter(F.concat(parts, F.split(end, r"\.")), lambda p: p != "")


def capitalised(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), token).otherwise(F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, 2, 1 << 20)))


def packed_row(file_id: Column, ordinal: Column) -> Column:
    return F.shiftleft(file_id.cast("long"), 20).bitwiseOR(ordinal.cast("long"))


def should_process(path: Column) -> Column:
    """Whether a change to this path is worth indexing: no temporary file, and a suffix that the
    watcher takes (slides and spreadsheets are left to the scan)."""
    name, own = base_name(path), suffix(path)
    ignored = reduce(Column.__or__, [name.startswith(x) for x in IGNORED_STARTS])
    watched = [*TEXT_SUFFIXES, *IMAGE_SUFFIXES, ".pdf", ".docx", ".ipynb"]
    return ~ignored & (own.isin(watched) | binary_kind(path).isNotNull())


def is_loopback(host: Column) -> Column:
    """Local names and addresses, in brackets or mapped into IPv6 as well; no host is local."""
    own = F.lower(F.trim(host, F.lit("[]")))
    return host.isNull() | own.isin("localhost", "", "::1", "0.0.0.0") | own.startswith("127.") | own.startswith("::ffff:127.")


def stem_of(path: Column) -> Column:
    """The name without its last suffix."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def parent_of(path: Column) -> Column:
    """The folder; ``.`` for a bare name."""
    found = F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)
    return F.when(~path.rlike(r"[\\/]"), ".").when(found == "", "/").otherwise(found)


def host_port(address: Column, port: int) -> Column:
    """struct(host, port) of ``host:port``, ``[v6]:port`` or a bare host."""
    host = F.regexp_extract(address, r"^(\[[^\]]*\]|[^:]*)", 1)
    own = F.regexp_extract(address, r"^(?:\[[^\]]*\]|[^:]*):([0-9]+)$", 1)
    return F.struct(F.trim(host, F.lit("[]")).alias("host"), F.when(own != "", own.cast("int")).otherwise(port).alias("port"))


def shown_size(n: Column, last: str = "TB") -> Column:
    """``human_size`` for display: nothing or zero is ``0 B``."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(human_size(n, last))


def shown_percent(score: Column) -> Column:
    return F.greatest(F.lit(0.0), score * 100)


def bar_width(share: Column, top: Column) -> Column:
    """Percent of the largest bar, two at least."""
    return F.greatest(F.lit(2.0), share * 100.0 / top)


def metadata_chunks(path: Column, entries: Column | None = None, media: Column | None = None) -> Column:
    """The two texts by which a file without readable text is found: its name and tokens, and a
    phrase of its words, type and contents (``entries``: names inside an archive, ``media``: what
    its tags say). No tokens, no texts."""
    kind, own = F.coalesce(binary_kind(path), F.lit("binary")), name_tokens(path)
    spoken = F.array_join(F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), capitalised), " ")
    called = kind
    for name, text in KIND_NAMES.items():
        called = F.when(kind == name, text).otherwise(called)
    phrase = F.trim(F.concat_ws(" ", spoken, F.upper(F.element_at(own, -1)), called))
    if entries is not None:
        inside = F.array_join(F.transform(entries, lambda e: F.translate(F.substring_index(e, "/", -1), "-_", "  ")), " ")
        phrase = F.when((kind == "archive") & (F.size(entries) > 0), F.concat(phrase, F.lit(". Contents: "), inside)).otherwise(phrase)
    if media is not None:
        phrase = F.when((kind == "media") & (F.coalesce(media, F.lit("")) != ""), F.concat(phrase, F.lit(". "), media)).otherwise(phrase)
    made = F.array(F.concat(base_name(path), F.lit(" "), F.array_join(own, " ")), phrase)
    return F.when(F.size(own) > 0, made).otherwise(F.array().cast("array<string>"))


def media_label(title: Column, artist: Column, seconds: Column, noun: str = "audio recording") -> Column:
    """``title by artist noun, length``; parts that are missing are left out."""
    head = F.concat_ws(" ", title, F.concat(F.lit("by "), artist), F.lit(noun))
    return F.concat_ws(", ", head, duration(seconds))


def marked(text: Column, terms: Column, width: int = 16) -> Column:
    """The run of ``width`` tokens that holds most of the terms (the first of equals), each term
    between ``<mark>`` and ``</mark>``, cut ends shown by an ellipsis; empty if none is held.
    ``text`` and ``terms`` (folded, sorted or not) are columns, not expressions."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}]+[^\p{L}\p{N}\p{M}]*"), 0)
    plain = lambda p: folded(F.regexp_extract(p, r"^[\p{L}\p{N}\p{M}]+", 0))
    held = F.transform(pieces, lambda p: F.when(F.array_contains(terms, plain(p)), plain(p)))
    at = F.sequence(F.lit(1), F.greatest(F.size(pieces) - width + 1, F.lit(1)))
    score = F.transform(at, lambda i: F.struct(F.size(F.array_distinct(F.filter(F.slice(held, i, width), lambda x: x.isNotNull()))).alias("n"), (-i).alias("back")))
    best = F.array_max(score)
    start = -best["back"]
    wrap = lambda p: F.when(F.array_contains(terms, plain(p)), F.concat(F.lit("<mark>"), F.regexp_extract(p, r"^[\p{L}\p{N}\p{M}]+", 0), F.lit("</mark>"), F.regexp_replace(p, r"^[\p{L}\p{N}\p{M}]+", ""))).otherwise(p)
    run = F.rtrim(F.array_join(F.transform(F.slice(pieces, start, width), wrap), ""))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), run, F.when(start + width <= F.size(pieces), "…").otherwise(""))
    return F.when((F.size(pieces) > 0) & (best["n"] > 0), cut).otherwise("")


def mark_parts(text: Column) -> Column:
    """A marked text for display: an array of struct(text, hit)."""
    parts = F.split(F.regexp_replace(text, "</?mark>", "\u0001"), "\u0001")
    # a text that isn't marked is one part; parts between an opening and a closing mark are hits
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("hit"))), lambda x: x["text"] != "")


def snippet(text: Column, terms: Column, before: int = 80, after: int = 160, head: int = 220) -> Column:
    """The surroundings of the first term found (in the terms' order), with an ellipsis at cut
    ends; else the text's beginning."""
    hit = F.get(F.filter(terms, lambda t: F.instr(F.lower(text), t) > 0), F.lit(0))
    at = F.instr(F.lower(text), hit)
    start = F.greatest(at - 1 - before, F.lit(0))
    end = F.least(at - 1 + after, F.length(text))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(hit.isNotNull(), cut).otherwise(F.substring(text, 1, head))
