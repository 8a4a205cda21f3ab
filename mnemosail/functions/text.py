"""Text functions as column expressions (no Python runs on the executors).

Spark's regular expressions are Java's: ``(?U)`` makes classes and boundaries
Unicode-aware, as the definitions need; ``(?d)`` keeps lines ended by ``\\n`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .literals import ascii_words, finds_any

SIGNAL_LIMIT = 2000


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_ascii(c: Column) -> Column:
    """Without blanks, tabs, line and page breaks at both ends, which is what DuckDB's regular expressions call white space."""
    return F.regexp_replace(c, r"\A[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def finds(c: Column, patterns: list[str]) -> Column:
    """If one of the patterns is found; texts without the words that a pattern needs are not searched for it."""
    return finds_any(c, patterns)


def is_boilerplate(c: Column) -> Column:
    s = strip(c)
    return s.startswith(P.BOILERPLATE_PREFIXES[0]) | s.startswith(P.BOILERPLATE_PREFIXES[1]) | s.rlike("(?U)" + P.BOILERPLATE_TAG)


def is_correction(c: Column, structural: bool = True) -> Column:
    """Regular-expression detector of corrections; ``structural``: one-word refusals on a line of their own too."""
    hit = finds(c, P.CORRECTION)
    if structural:
        hit = hit | c.rlike(ascii_words(P.CORRECTION_LINE, lines=True))
    return F.coalesce((c != "") & (F.length(c) <= SIGNAL_LIMIT) & ~is_boilerplate(c) & hit, F.lit(False))


def is_instruction(c: Column) -> Column:
    return F.coalesce(F.length(c).between(20, SIGNAL_LIMIT) & finds(c, P.INSTRUCTION), F.lit(False))


def loose_prefilter(c: Column) -> Column:
    return finds(c, P.LOOSE_CUES)


def worth_asking(c: Column) -> Column:
    """False for acknowledgements, bare links and texts under four characters."""
    s = strip(c)
    return ~((F.length(s) < 4) | s.rlike(ascii_words(P.TRIVIAL_ACK)) | s.rlike(ascii_words(P.BARE_URL)))


def user_text(content: Column, blocks: Column) -> Column:
    """Typed text of a user message: ``content`` if it is plain, else what its blocks hold.

    blocks: array of structs with ``type`` and ``text``.
    """
    query = r"(?s)<user_query>\s*(.*?)\s*</user_query>"

    def one(b: Column) -> Column:
        t = F.coalesce(b["text"], F.lit(""))
        return F.when(t.rlike(query), F.regexp_extract(t, query, 1)).when(~t.startswith("<external_links>"), t)

    kept = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), one), lambda t: t.isNotNull())
    raw = strip(F.array_join(kept, "\n"))
    return F.coalesce(content, F.when(is_boilerplate(raw), "").otherwise(raw))


def assistant_text(content: Column, blocks: Column) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(content, strip(F.array_join(texts, "\n")))


def tool_call(block: Column) -> Column:
    """(tool, server) of a block that calls a server's tool, in the older or the newer form; else null.

    block: struct with ``name``, and ``input`` as a JSON string.
    """
    field = lambda k: F.coalesce(F.get_json_object(block["input"], f"$.{k}"), F.lit(""))
    old, new = block["name"] == "CallMcpTool", block["name"] == "CallDynamicTool"
    return F.when(old | new, F.struct(field("toolName").alias("tool"), F.when(old, field("server")).otherwise(field("namespace")).alias("server")))


def effective_tool(block: Column, own: str = "cursor") -> Column:
    """Tool name; calls of the editor's own tools through the newer wrapper are unwrapped."""
    inner = F.coalesce(F.get_json_object(block["input"], "$.toolName"), block["name"])
    wrapped = (block["name"] == "CallDynamicTool") & (F.get_json_object(block["input"], "$.namespace") == own)
    return F.when(wrapped, inner).otherwise(F.coalesce(block["name"], F.lit("")))


def recalled_bank(server: Column, banks: list[str]) -> Column:
    """The longest bank that the server's name is, or ends in after a hyphen; else null."""
    out = F.lit(None).cast("string")
    for b in sorted(banks, key=lambda b: (len(b), b)):
        out = F.when((server == b) | (server == f"user-{b}") | server.endswith(f"-{b}"), b).otherwise(out)
    return out


def server_name(c: Column) -> Column:
    """Server without scope suffix and project prefix; names under ``user-`` stay apart."""
    s = F.regexp_replace(c, P.SCOPE_SUFFIX, "")
    return F.when(s.startswith("user-"), s).otherwise(F.regexp_replace(s, P.PROJECT_PREFIX, ""))


def project_label(path: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Label of the first prefix, in the given order, that the path starts with."""
    out = F.lit(None).cast("string")
    for prefix, label in reversed(prefixes):
        out = F.when(path.startswith(prefix), label).otherwise(out)
    return out


def hit_of(result_json: Column) -> Column:
    """True if a tool result (JSON text within JSON) starts with a text block and is no error."""
    inner = F.get_json_object(result_json, "$.result")
    return F.coalesce((F.get_json_object(inner, "$.content[0].type") == "text") & (F.coalesce(F.get_json_object(inner, "$.isError"), F.lit("false")) != "true"), F.lit(False))


def has_ink(c: Column) -> Column:
    """True if something is not white space."""
    return c.rlike(r"(?U)\S")


def valuable(c: Column) -> Column:
    return finds(c, P.VALUABLE)


def triage_base(c: Column) -> Column:
    """Reasons that the text itself gives."""
    kind = F.when(finds(c, P.EPHEMERAL + P.EPHEMERAL_REQUEST), "ephemeral").when(finds(c, P.SNAPSHOT), "snapshot")
    return F.array_compact(F.array(kind, F.when(F.length(c) < 80, "short")))


def with_stale(base: Column, date: Column, cutoff: Column) -> Column:
    """Reasons, and ``stale`` where there are any and the date is before the cutoff."""
    old = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd") < cutoff
    return F.when(F.coalesce(old, F.lit(False)) & (F.size(base) > 0), F.concat(base, F.array(F.lit("stale")))).otherwise(base)


def triage_reasons(c: Column, date: Column, cutoff: Column) -> Column:
    """Why a stored statement may go: an array, empty if it stays. ``memory.triage`` gives the same for tables, with less work."""
    text, none = F.coalesce(c, F.lit("")), F.array().cast("array<string>")
    return F.when(~has_ink(text), F.array(F.lit("empty"))).when(valuable(text), none).otherwise(with_stale(triage_base(text), date, cutoff))


def normalized_statement(c: Column) -> Column:
    """Lower case, single blanks, without trailing qualifiers, at most 200 characters."""
    s = squeeze(strip(F.lower(c)))
    for mark in ("when", "involving"):
        s = F.regexp_replace(s, rf"(?iU)\| {mark}:.*$", "")
    return F.substring(s, 1, 200)


def entities(c: Column) -> Column:
    found = [F.regexp_extract_all(c, F.lit("(?U)" + p), 0) for p in P.ENTITIES]
    return F.array_distinct(F.concat(*found))


def topics(c: Column) -> Column:
    low = F.lower(c)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), t) for k, t in P.TOPICS.items()])))


def salience(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), 0)
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    some = (F.size(entities(c)) > 0) | (F.size(topics(c)) > 0)
    return F.when(has(P.HIGH_SALIENCE), "high").when(has(P.LOW_SALIENCE), "low").when(some, "medium").otherwise("low")


def extraction(c: Column) -> Column:
    """struct(entities, topics, salience); texts under eight characters have none and are low."""
    small = F.length(strip(F.coalesce(c, F.lit("")))) < 8
    none = F.array().cast("array<string>")
    pick = lambda whole, rest: F.when(small, rest).otherwise(whole)
    return F.struct(pick(entities(c), none).alias("entities"), pick(topics(c), none).alias("topics"), pick(salience(c), F.lit("low")).alias("salience"))


def json_part(c: Column) -> Column:
    """From the first opening to the last closing brace, if that parses."""
    part = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(part).isNotNull() & (part != ""), part)


def document_key(base: Column, key: Column, sep: str = "-") -> Column:
    return F.when(key == "", base).otherwise(F.concat(base, F.lit(sep), key))


def path_slug(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("/"), F.lit("--")), F.lit(".md"), F.lit(""))


def stable_key(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def reason_category(c: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(c, ":", 1), "(", 1))


def capped_comment(login: Column, body: Column, most: int = 2000, mark: str = "\n[...truncated]", trim=strip) -> Column:
    b = trim(F.coalesce(body, F.lit("")))
    b = F.when(F.length(b) > most, F.concat(F.substring(b, 1, most), F.lit(mark))).otherwise(b)
    return F.concat(F.lit("**@"), F.coalesce(login, F.lit("?")), F.lit(":**\n"), b)


def release_line(branch: Column, folder: Column, known: list[str]) -> Column:
    """Release of a branch ``release/vX``, or else of a folder ``...-vX.Y``, if it is known."""
    from_branch = F.nullif(F.regexp_extract(branch, r"^release/v(.+)$", 1), F.lit(""))
    from_folder = F.nullif(F.regexp_extract(folder, r"-v(\d+\.\d+)$", 1), F.lit(""))
    line = F.coalesce(from_branch, from_folder)
    return F.when(line.isin(known), line)


def overview(c: Column) -> Column:
    """Front-matter overview, up to the to-dos or the closing rule."""
    return strip(F.regexp_extract(c, r"(?sm)^overview:\s*(.*?)(?=\ntodos:|\n---)", 1))
