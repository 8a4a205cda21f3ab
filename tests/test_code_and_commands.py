"""Code splitting by its properties, commands as a source, passages without the automaton."""

import random
import time

import pytest

from mnemosail.operators import chunking, evidence
from mnemosail.operators.code_split import CUTS, EXTENSIONS, LANGUAGE, code_spans, language_of, parts_of
from mnemosail.sources.commands import Command, command_items, items

PYTHON = '''import os


# what it does
# and how
@decorated
def first(a, b):
    """Text."""
    return a


class Second:
    """More."""

    x = 1

    def method(self):
        return 2

    @property
    def other(self):
        return 3


async def third():
    pass
'''
GO = "package p\n\nimport (\n\t\"fmt\"\n)\n\n// Run runs.\nfunc Run() {\n\tx := 1\n\n\tfmt.Println(x)\n}\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) M() int {\n\treturn 2\n}\n"


def pieces(text, path, size, overlap=0):
    return [text[a:b] for _, a, b in code_spans(text, path, size, overlap)]


def test_languages():
    assert (language_of("a/b.PY"), language_of("x.go"), language_of("a.b/c"), language_of("Makefile"), language_of(None), language_of(".py")) == ("python", "go", None, None, None, "python")
    assert set(CUTS) == {None, *EXTENSIONS} and all(LANGUAGE[e] in EXTENSIONS for e in LANGUAGE)


def test_declarations_stay_whole():
    assert pieces(PYTHON, "m.py", 130) == [PYTHON[: PYTHON.index("class")], PYTHON[PYTHON.index("class") : PYTHON.index("    @property")], PYTHON[PYTHON.index("    @property") :]]
    assert any(p.startswith("# what it does") and "return a" in p for p in pieces(PYTHON, "m.py", 90))
    go = pieces(GO, "m.go", 70)
    assert any(p.startswith("// Run runs.\nfunc Run") and p.rstrip().endswith("}") for p in go) and any(p.startswith("type T struct") for p in go)
    assert pieces(PYTHON, "m.py", 5000) == [PYTHON]
    plain = pieces(PYTHON, "m.unknown", 130)
    assert all(p.endswith("\n") for p in plain) and plain != pieces(PYTHON, "m.py", 130)


@pytest.mark.parametrize("size,overlap", [(1000, 300), (50, 20), (30, 0), (7, 3), (1, 0), (40, 39)])
def test_chunks_cover_the_text(size, overlap):
    r = random.Random(size)
    for k in range(60):
        bits = ["def f():\n", "    return 1\n", "\n", "\n\n", "x" * r.randrange(90), "class A {\n", "}\n", "// c\n", "# h\n", " ", "é中", "func g() {\n"]
        text = "".join(r.choices(bits, k=r.randrange(0, 60)))
        path = f"a.{r.choice(['py', 'go', 'ts', 'java', 'rs', 'md', 'txt', 'sql', 'sh', 'yaml', 'rb', 'proto'])}"
        spans = code_spans(text, path, size, overlap)
        assert [k for k, _, _ in spans] == list(range(len(spans))) and spans[0][1] == 0 and spans[-1][2] == len(text)
        for (_, a, b), (_, c, d) in zip(spans, spans[1:]):
            assert a <= c <= b < d and b - c <= overlap  # no gap, no more overlap than asked for
        assert all(0 < b - a <= size for _, a, b in spans) or text == ""
        ends = parts_of(text, CUTS[language_of(path)], size, max(1, overlap))
        assert ends == sorted(set(ends)) and (not text or ends[-1] == len(text))


@pytest.mark.parametrize("text,path", [("# c\n" * 100_000, "a.py"), ("x" * 1_000_000, "a.java"), ("static int f(int a, " * 20_000, "a.java"), ("\n" * 300_000, "a.go"), ("public static final " * 30_000, "a.ts"), ("@a\n" * 50_000 + "def f", "a.py")])
def test_odd_files_take_linear_time(text, path):
    began = time.perf_counter()
    code_spans(text, path)
    assert time.perf_counter() - began < 8


def test_chunks_of_files(spark):
    df = spark.createDataFrame([("a.py", PYTHON * 30), ("b", None), ("c.go", ""), (None, "x")], "filepath string, code string")
    got = chunking.code_chunks(df).collect()
    mine = sorted((r for r in got if r.filepath == "a.py"), key=lambda r: r.chunk_index)
    assert [r.code for r in mine] == pieces(PYTHON * 30, "a.py", 1000, 300) and mine[1].id == "a.py:1" and mine[1].search_text == "a.py " + mine[1].code
    assert all(r.code.lstrip().startswith(("import", "#", "@", "def", "class", "async", '"""', "x =", "return", "pass")) for r in mine)
    assert len([r for r in got if r.filepath != "a.py"]) == 3


def test_commands_fail_alone(spark):
    lines = ["sh", "-c", """printf '{"n":1}\\n\\n{"n":"é"}\\n'"""]
    array = ["sh", "-c", """printf '[\\n{"n":1},{"n":2}]'"""]
    broken = ["sh", "-c", """printf '{"n":7}\\nnot json\\n{"n":8}\\n'"""]
    ends = ["sh", "-c", """printf '{"n":9}\\n'; echo went wrong >&2; exit 3"""]
    got = command_items(spark, {"lines": lines, "array": array, "broken": broken, "ends": ends, "absent": ["/no/such/program"], "slow": ["sleep", "60"], "none": ["true"]}, timeout=3)
    rows = sorted((r.kind, r.item or "", (r.error or "").partition(":")[0]) for r in got.collect())
    assert rows == [
        ("absent", "", "FileNotFoundError"), ("array", '{"n": 1}', ""), ("array", '{"n": 2}', ""), ("broken", "", "no JSON"), ("broken", '{"n": 7}', ""), ("ends", "", "exit 3"),
        ("ends", '{"n": 9}', ""), ("lines", '{"n": "é"}', ""), ("lines", '{"n": 1}', ""), ("slow", "", "no end after 3 s"),
    ]
    assert got.rdd.getNumPartitions() == 7
    (error,) = [e for _, _, e in items(Command("x", ends[:2] + ["echo went wrong >&2; exit 3"], 5.0))]
    assert error == "exit 3: went wrong"


def test_passages_without_the_automaton(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choices("abc ", k=5000))
    passages = [(k, text[a : a + n]) for k in range(60) for a, n in [(r.randrange(4900), r.randrange(1, 60))]] + [(100, "zz"), (101, "ab"), (100, "ab")]
    want = {i for i, p in passages if p in text}
    assert evidence.Passages(passages).within(text) == want
    monkeypatch.setattr(evidence, "ahocorasick", None)
    plain = evidence.Passages(passages)
    assert plain.automaton is None and plain.within(text) == want and plain.within("") == set() and evidence.Passages([]).within("x") == set()


def test_passages_in_several_chunks(spark):
    docs = spark.createDataFrame([(k, f"text {k} with passage {k % 3} in it") for k in range(9)] + [(None, "passage 1"), (9, None)], "doc_id long, text string")
    items_ = spark.createDataFrame([(k, f"passage {k}") for k in range(3)] + [(None, "with"), (7, ""), (8, None)], "item_id long, text string")
    whole = sorted(map(tuple, evidence.holders(docs, items_).collect()), key=str)
    assert sorted(map(tuple, evidence.holders(docs, items_, chunk=5).collect()), key=str) == whole and len(whole) == 19
