"""Code split at its structure: declarations first, then blank lines, lines and characters.

A file's language follows from its extension and gives the places where it may be cut, from the
most to the least welcome: lines that begin a declaration at the top level, the same one
level in, blank lines, ends of lines, any character. A text longer than a chunk is cut at the first kind; parts that are still
too long are cut at the next kind, and so on. Neighbouring parts are then merged up to the chunk size,
and a chunk begins with those parts before it that fit into the overlap. This knows the look of declarations, not the grammar:
a line inside a string that looks like one is a place to cut.

Chunks are spans of the text: they cover it, none is longer than ``size``, and only their overlaps repeat. Null and
empty texts are one empty chunk.
"""

from __future__ import annotations

import re

# Extensions of the languages whose declarations are known.
EXTENSIONS = {
    "python": "py pyi pyw", "go": "go", "script": "js jsx mjs cjs ts tsx mts", "brace": "java c h cc cpp cxx hpp cs kt kts scala swift php dart groovy",
    "rust": "rs", "ruby": "rb rake", "shell": "sh bash zsh", "markdown": "md mdx markdown", "sql": "sql", "yaml": "yaml yml", "proto": "proto thrift",
}
LANGUAGE = {ext: name for name, exts in EXTENSIONS.items() for ext in exts.split()}

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|inline|extern|const|async|export|default|declare)\s+)*"
#: Beginnings of declarations after a line's indentation.
DECLARED = {
    "python": r"(?:@\w|def |class |async def |if __name__)",
    "go": r"(?:func |type |var |const |import )",
    "script": rf"{_MODIFIERS}(?:function\b|class |interface |type |enum |namespace |const |let |var |describe\()",
    "brace": rf"(?:{_MODIFIERS}(?:class|interface|enum|struct|namespace|trait|object|fun|func|def|function|record|protocol|extension|template)\b|{_MODIFIERS}[\w<>\[\],.*&: ]{{1,200}}\([^;\n]{{0,400}}\)[^;\n]{{0,200}}\{{)",
    "rust": r"(?:#\[|(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|impl|trait|mod|type|const|static|unsafe fn|async fn)\b)",
    "ruby": r"(?:def |class |module |describe )",
    "shell": r"(?:function \w|\w+\(\)\s*\{)",
    "markdown": r"#{1,6} ",
    "sql": r"(?i:create|alter|insert|update|delete|select|with|drop|grant)\b",
    "yaml": r"(?:---|[\w.\-\"']+:)",
    "proto": r"(?:message|service|enum|rpc|extend|struct) ",
}
#: Lines that belong to the declaration after them: comments and decorations.
LEADING = {"python": r"[#@].*", "go": r"//.*", "script": r"(?://|@).*", "brace": r"(?://|/?\*|@\w|\[).*", "rust": r"(?://|#\[).*", "ruby": r"#.*", "shell": r"#.*", "proto": r"//.*", "sql": r"--.*"}


def cuts_of(language: str | None) -> list[tuple[re.Pattern, re.Pattern | None]]:
    """Places to cut, the most welcome first: a match's end is where the next part begins. With each what must not be a part of its own."""
    out = []
    if language:
        lead, word = LEADING.get(language), DECLARED[language]
        alone = re.compile(rf"(?:[ \t]*{lead}\n)+") if lead else None
        either = rf"(?:{word}|{lead})" if lead else word
        out.append((re.compile(rf"\n(?={either})"), alone))
        if language not in ("markdown", "sql"):
            out.append((re.compile(rf"\n(?=(?:    |  |\t)(?:    )?{either})"), alone))
    return [*out, (re.compile(r"\n[ \t]*\n+"), None), (re.compile(r"\n"), None)]


CUTS = {language: cuts_of(language) for language in (None, *EXTENSIONS)}


def language_of(path: str | None) -> str | None:
    """By the extension of the file's name; none is known for others."""
    name = (path or "").rpartition("/")[2]
    return LANGUAGE.get(name.rpartition(".")[2].lower()) if "." in name else None


def parts_of(text: str, cuts: list[tuple[re.Pattern, re.Pattern | None]], size: int, piece: int) -> list[int]:
    """Ends of the parts: cut where it is welcome, further only where parts are longer than ``size``."""
    spans = [(0, len(text))]
    for cut, alone in cuts:
        if all(b - a <= size for a, b in spans):
            break
        fine = []
        for a, b in spans:
            if b - a <= size:
                fine.append((a, b))
                continue
            start = before = a
            leading = True  # comments stay with what they are about
            for m in cut.finditer(text, a, b):
                leading = alone is not None and leading and alone.fullmatch(text, before, m.end()) is not None
                before = m.end()
                if start < before < b and not leading:
                    fine.append((start, before))
                    start, leading = before, True
            fine.append((start, b))
        spans = fine
    return [e for a, b in spans for e in ([b] if b - a <= size else [*range(a + piece, b, piece), b])]


def code_spans(text: str, path: str | None = None, size: int = 1000, overlap: int = 300) -> list[tuple[int, int, int]]:
    """(number, start, stop) of the chunks."""
    piece = max(1, min(overlap, size - overlap)) if overlap else size
    ends = parts_of(text, CUTS[language_of(path)], size, piece)
    starts = [0, *ends[:-1]]
    out, first, last, n = [], 0, 0, len(ends)
    while last < n:
        stop = last + 1
        while stop < n and ends[stop] - starts[first] <= size:
            stop += 1
        out.append((len(out), starts[first], ends[stop - 1]))
        last = stop
        if last < n:  # what fits into the overlap, and leaves room for the next part
            first = last
            while first > 0 and ends[last - 1] - starts[first - 1] <= overlap and ends[last] - starts[first - 1] <= size:
                first -= 1
    return out or [(0, 0, 0)]

