"""Literal fixtures with results worked out by hand."""

import datetime
import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemosail.functions import numbers as N
from mnemosail.functions import text as T
from mnemosail.functions import vectors as V
from mnemosail.operators import chunking as C
from mnemosail.operators import evidence as E
from mnemosail.operators import ingest as G
from mnemosail.operators import memory as M
from mnemosail.operators import rollups as R
from mnemosail.operators import search as S
from mnemosail.operators import sessions as X
from mnemosail.sources import files
from mnemosail.sources import readers as IO
from mnemosail.streaming import progress as P
from tests.conftest import DATA


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


CHUNKS = [("r1", "pkg/foo.go", [1.0, 0.0, 0.0, 0.0], "alphaterm only in r1"), ("r2", "pkg/bar.go", [0.0, 1.0, 0.0, 0.0], "betaterm only in r2"), ("r3", "pkg/baz.go", [0.7, 0.7, 0.0, 0.0], "alphaterm and betaterm both in r3")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(CHUNKS, "id string, filepath string, embedding array<float>, search_text string")


@pytest.fixture
def qv(spark):
    return spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],)], "q array<float>")


def test_dense_order(corpus, qv):
    got = S.search(corpus, qv, "", 3, "dense").orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("r1", 1.0), ("r3", 0.7071), ("r2", 0.0)]


def test_lexical_set_and_hybrid_first(corpus, qv):
    assert {r.id for r in S.search(corpus, qv, "alphaterm", 3, "lexical").collect()} == {"r1", "r3"}
    assert S.search(corpus, qv, "  ", 3, "lexical").count() == 0
    hybrid = S.search(corpus, qv, "alphaterm", 3).orderBy("rank").collect()
    assert hybrid[0].id == "r1" and len({r.id for r in hybrid}) == len(hybrid) == 3
    assert hybrid[0].rrf_score == round(1 / 61 + 1 / 61, 6)


def test_prefix_words_are_all_needed(corpus, qv):
    assert {r.id for r in S.search(corpus, qv, "alpha beta", 3, "lexical").collect()} == {"r3"}


def brute_density(text, terms):
    words = [w for w in re.split(r"[^a-z0-9_]+", text.lower()) if w]
    hits = [k for k, w in enumerate(words) if any(w.startswith(t) for t in terms)]
    runs = [(a, z) for a in hits for z in hits if a <= z and all(any(words[k].startswith(t) for k in range(a, z + 1)) for t in terms)]
    shortest = [(a, z) for a, z in runs if not any((b, y) != (a, z) and a <= b and y <= z for b, y in runs)]
    return sum(0.1 / (1 + sum(1 for k in range(a, z + 1) if k not in hits)) for a, z in shortest)


def test_rank_of_several_words(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "alphabet", "beta", "gamma", "x", "y", "al_be"]) for _ in range(r.randrange(1, 25))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for query in ("alpha beta", "alpha beta gamma", "al alpha", "beta"):
        got = [x.v for x in df.select("t", V.rank(F.lower("t"), query).alias("v")).collect()]
        hit = [x.v for x in df.select(V.matches_all(F.lower("t"), query).alias("v")).collect()]
        for t, v, h in zip(texts, got, hit, strict=True):
            assert v == pytest.approx(brute_density(t, query.split()))
            assert h == all(any(w.startswith(q) for w in t.split()) for q in query.split())
    assert not one(spark, V.matches_all(F.lit("a-b"), "a-b")) and one(spark, V.prefix_frequency(F.lit("a-b"), "a-b")) == 0


def test_changed_text_changes_the_match_set(spark, corpus, qv):
    changed = corpus.withColumn("search_text", F.when(F.col("id") == "r1", "gammaterm").otherwise(F.col("search_text")))
    assert {r.id for r in S.search(changed, qv, "alphaterm", 3, "lexical").collect()} == {"r3"}
    assert {r.id for r in S.search(changed, qv, "gamma", 3, "lexical").collect()} == {"r1"}


def test_seeds_in_blocks(spark):
    r = random.Random(2)
    vec = lambda: [r.gauss(0, 1) for _ in range(4)]
    rows_, seeds = [(k, vec()) for k in range(20)], [(vec(),) for _ in range(9)]
    a = spark.createDataFrame(rows_, "id long, embedding array<float>"), spark.createDataFrame(seeds, "seed array<float>")
    whole, parts = ({x.id: x.best for x in S.nearest_seed(*a, 0.5, block=b).collect()} for b in (100, 2))
    assert whole == pytest.approx(parts) and len(whole) == 20


def test_pattern_matches_in_order(spark):
    df = spark.createDataFrame([("b", "1", "f(1) f(2)"), ("a", "2", "f(3)"), ("a", "1", "none")], "root string, filepath string, code string")
    assert [(x.root, x.place, x.hit) for x in S.pattern_matches(df, r"f\((\d)\)", 2, group=1).collect()] == [("a", 0, "3"), ("b", 0, "1")]


def test_fusion_limit(spark):
    leg = lambda ids: spark.createDataFrame([(i, "p", 1.0, k + 1) for k, i in enumerate(ids)], "id string, filepath string, score double, rank int")
    got = S.fuse(leg("ab"), leg("ac"), 10).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b", "c"]
    assert S.fuse(leg("ab"), leg("ac"), 2).count() == 2


def test_window_spans():
    assert C.window_spans("x" * 1390, 800, 200) == [(0, 0, 800), (1, 600, 1390), (2, 1200, 1390)]
    assert C.window_spans("", 800, 200) == [(0, 0, 0)]
    text = "line\n" * 500
    spans = C.window_spans(text, 800, 200)
    assert all(text[b - 1] == "\n" for _, _, b in spans) and spans[-1][2] == len(text)


def test_windows_native_equals_python(spark):
    for n in (1, 799, 800, 801, 1400, 2000, 20_000):
        df = spark.createDataFrame([("y" * n,)], "t string")
        assert df.select(C.even_windows(F.col("t")).alias("w")).first().w == df.select(C.fixed_windows(F.col("t")).alias("w")).first().w
    with pytest.raises(ValueError):
        C.fixed_windows(F.lit("a"), 100, 60)


def sections(spark, text):
    return {r.key: r.chunk for r in C.markdown_sections(spark.createDataFrame([(text,)], "t string"), "t").collect()}


def test_section_keys_are_stable(spark):
    doc = "# Title\nintro\n## Section A\naaa\n## Section B\nbbb\n"
    base = sections(spark, doc)
    assert len(base) == 3 and "" in base and all(len(k) in (0, 16) for k in base)
    after = sections(spark, "# New\nnews\n" + doc)
    kept = {k: v for k, v in base.items() if k}
    assert kept.items() <= after.items()
    assert sections(spark, "# Hello\nbody") == {"": "# Hello\nbody"}
    assert sections(spark, "lead\n# H\nx")[""] == "lead\n"
    long = sections(spark, "# A\nx\n# H\n" + "x" * 2000)
    assert {k.split("-")[-1] for k in long if "-" in k} == {"part1", "part2", "part3"}


def test_issue_sections(spark):
    df = spark.createDataFrame([("head", ["first", "w" * 3000])], "h string, c array<string>")
    keys = {r.key for r in C.issue_sections(df, "h", "c").collect()}
    assert {"", "comment0", "comment1", "comment1-part1"} <= keys


def blocks(rows):
    call = lambda t: t and Row(name=t[0], call=t[1] and Row(tool=t[1][0], server=t[1][1]))
    return [(1, k, role, text, n, [call(t)] if t else []) for k, (role, text, n, t) in enumerate(rows)]


SCHEMA = "t long, raw_idx long, role string, text string, chars long, tools array<struct<name:string,call:struct<tool:string,server:string>>>"


def test_preamble_stops_at_the_first_change(spark):
    rows = [("user", "hi", 2, None), ("user", "A" * 20_000, 20_000, None), ("assistant", "", 53, ("CallMcpTool", ("recall", "hindsight-docs"))), ("user", "ok", 2, None), ("assistant", "", 50_000, ("Write", None)), ("user", "done", 4, None)]
    got = X.facts(spark.createDataFrame(blocks(rows), SCHEMA), ["hindsight", "hindsight-docs"]).first()
    assert got.preamble_chars == 20_057 and got.context_loading_tokens == round(20_057 / 4)
    assert got.has_recall and got.proactive and got.banks_recalled == ["hindsight-docs"] and got.first_productive_turn == 2
    assert X.facts(spark.createDataFrame(blocks(rows[:5]), SCHEMA), []).count() == 0


def test_rework_and_learning_windows(spark):
    rows = [("user", "hello there", 11, None), ("assistant", "x" * 500, 500, None), ("user", "no, that's wrong. fix", 21, None), ("assistant", "done", 4, None), ("user", "we always use the linter here", 29, None), ("assistant", "ok", 2, None)]
    df = spark.createDataFrame(blocks(rows), SCHEMA)
    got = {r.tag: r for r in X.learning_windows(df).collect()}
    assert set(got) == {"CORRECTION", "INSTRUCTION"}
    lines = got["CORRECTION"].window.split("\n\n")
    assert len(lines) == 5 and lines[2] == "[CORRECTION] User: no, that's wrong. fix" and lines[1] == "Assistant: " + "x" * 300
    f = X.facts(df, []).first()
    assert f.corrections == 1 and f.rework_tokens == round(((567 - 532) // 2) / 4)
    assert X.learning_windows(df, start=3).count() == 1


def test_correction_cost(spark):
    rows = [("user", "a", 1, None), ("assistant", "b", 100, None), ("assistant", "c", 40, None), ("user", "no, that's wrong", 16, None), ("user", "undo that", 9, None)]
    got = X.consumption(spark.createDataFrame(blocks(rows), SCHEMA)).first()
    assert got.corrections == 2 and got.correction_cost_tokens == (40 + 16 + 9) // 4


@pytest.mark.parametrize(("text", "want"), [("no, that's wrong", True), ("Nope.", True), ("fine\nwrong\nok", True), ("mistake a refactoring for a checkpoint", True), ("all good", False), ("", False), ("wrong file " * 300, False), ("<system_reminder> wrong file", False)])
def test_corrections(spark, text, want):
    assert one(spark, T.is_correction(F.lit(text))) is want


def test_server_names(spark):
    names = ["hindsight-docs", "alpha-hindsight-docs", "alpha-v1.6-hindsight-docs", "project-0-alpha-hindsight-docs", "hindsight-docs::mcpScope:x"]
    assert {one(spark, T.server_name(F.lit(n))) for n in names} == {"hindsight-docs"}
    assert one(spark, T.server_name(F.lit("user-hindsight-docs"))) == "user-hindsight-docs"


def test_tool_calls(spark):
    block = lambda n, i: F.struct(F.lit(n).alias("name"), F.lit(json.dumps(i)).alias("input"))
    assert one(spark, T.tool_call(block("CallMcpTool", {"toolName": "recall", "server": "s"}))) == Row(tool="recall", server="s")
    assert one(spark, T.tool_call(block("CallDynamicTool", {"toolName": "recall", "namespace": "n"}))) == Row(tool="recall", server="n")
    assert one(spark, T.tool_call(block("Read", {}))) is None
    assert one(spark, T.effective_tool(block("CallDynamicTool", {"toolName": "Task", "namespace": "cursor"}))) == "Task"


def test_older_copies(spark):
    df = spark.createDataFrame([("old-1", "h1", "2026-01-01"), ("newest-1", "h1", "2026-03-01"), ("mid-1", "h1", "2026-02-01"), ("unique-1", "h2", "2026-01-01"), ("null-1", None, "2026-01-01"), ("null-2", None, "2026-01-02")], "id string, h string, created string")
    assert {r.id for r in M.older_copies(df, "h", "created", "id").collect()} == {"old-1", "mid-1", "null-1"}


def test_triage(spark):
    cut = F.to_date(F.lit("2026-01-15"))
    why = lambda t, d="2026-01-01": one(spark, T.triage_reasons(F.lit(t), F.lit(d), cut))
    assert why("  ") == ["empty"]
    assert why("The assistant is implementing x; we must keep it") == []
    assert why("The assistant is implementing x") == ["ephemeral", "short", "stale"]
    assert why("currently running " + "x" * 80, "2026-02-01") == ["snapshot"]
    assert why("x" * 79, "2026-02-01") == ["short"] and why("x" * 80) == []
    assert why("user requested a change", "bad date") == ["ephemeral", "short"]
    assert why("user requested this always") == []


def test_ratio_is_the_sequence_matcher(spark):
    a, b = "the quick brown fox " * 10, "the quick brawn fox " * 10
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(M.sequence_ratio(F.col("a"), F.col("b")).alias("r")).first().r == SequenceMatcher(None, a, b).ratio()


def test_duplicate_tie_removes_the_first(spark):
    facts = spark.createDataFrame([(1, "d", "2026-01-01"), (2, "d", "2026-01-01"), (3, "d", "2025-01-01")], "id long, text string, date string")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a long, b long, ratio double")
    assert sorted(r.id for r in M.duplicate_removals(pairs, facts).collect()) == [1, 3]


def test_removals_cover_copies(spark):
    import random

    r, facts = random.Random(12), []
    bases = [f"{k} " + "the quick brown fox jumps over the lazy dog today " * 3 for k in "abc"]
    forms = [b + "".join(r.choice("xyz ") for _ in range(r.randrange(30, 60))) for b in bases for _ in range(4)]
    forms += [bases[0] + "q" * 40 + t for t in (" one", " two")] + ["short", "| when: now", "  ", None]
    for i in range(1, 121):
        text = r.choice(forms)
        facts.append((i, text and r.choice([text, text.upper(), text + " | when: later"]), r.choice([None, "2026-01-01", "2026-01-02", "2026-01-03"])))
    df = spark.createDataFrame(facts, "id long, text string, date string").repartition(3)
    norm = {x.id: x.n for x in df.select("id", T.normalized_statement(F.col("text")).alias("n")).collect()}
    rows = [(i, norm[i], d or "") for i, t, d in facts if (t or "").strip()]
    want = {i if d <= e else j for k, (i, n, d) in enumerate(rows) for j, m, e in rows[k + 1 :] if n[:50] == m[:50] and SequenceMatcher(None, n, m).ratio() > 0.85}
    got = [x.id for x in M.near_duplicate_removals(df).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(rows)
    kept = spark.createDataFrame([(1, "same words", "2026-01-01"), (2, "same words", "2026-01-02"), (3, "same words", "2026-01-02")], "id long, text string, date string")
    assert sorted(x.id for x in M.near_duplicate_removals(kept).collect()) == [1, 2]


def test_resolution(spark):
    rows = [(True, False, ["m"], None, True, 0, 0.95), (True, False, ["m"], None, True, 0, 0.5), (True, False, ["m"], None, True, 3, 0.95), (False, False, ["m"], None, True, 0, 0.95), (True, False, [], None, None, None, None)]
    df = spark.createDataFrame(rows, "enabled boolean, recall_failed boolean, memories array<string>, error string, contradicts boolean, idx int, confidence double")
    assert [r.action for r in M.resolve(df).collect()] == ["auto_resolved", "queued", "retain", "retain", "retain"]


def test_extraction(spark):
    got = one(spark, T.extraction(F.lit("The CocoIndex API must never lose a watermark")))
    assert got.entities == ["CocoIndex", "API"] and got.topics == ["cocoindex", "watermark"] and got.salience == "high"
    for t in ("", "hi"):
        assert one(spark, T.extraction(F.lit(t))) == Row(entities=[], topics=[], salience="low")


def test_numbers(spark):
    assert one(spark, N.tokens_rounded(F.lit(10))) == 2 and one(spark, N.tokens_rounded(F.lit(14))) == 4 and one(spark, N.tokens_floored(F.lit(15))) == 3
    assert one(spark, N.iso_week(F.lit(datetime.date(2024, 12, 30)))) == "2025-W01"
    assert one(spark, N.fact_time(F.lit("bad"))) is None


def test_empty_sessions_give_zeros(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = R.effectiveness(X.facts(none, [])).first()
    assert got.sessions_with_recall == 0 and got.recall_adoption_pct == 0.0 and got.agent_turns == 0
    assert {r.size_bucket for r in R.distribution(X.facts(none, [])).collect()} == set(R.CLASSES)


def test_rich_text():
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "mention", "attrs": {"text": "@b"}}]}, {"type": "rule"}]}
    assert C.flatten_json(json.dumps(tree)) == "a\n@b\n\n---\n" and C.flatten_json("{bad") == "" and C.flatten_json(None) == ""


def test_board_counts_items_without_title(spark):
    items = spark.createDataFrame([("Doing", "x", 1), ("Odd", "y", 0), ("Done", None, 2)], "status string, title string, place int")
    got = {r.status: r for r in G.board(items, ["Doing"]).collect()}
    assert set(got) == {"Doing", "Odd"} and got["Doing"].total == 3 and got["Doing"].known_rank == 0


def test_globs(spark):
    ok = lambda p: one(spark, IO.included(F.lit(p), ["**/*.go"], ["vendor/**", "**/*_test.go"]))
    assert ok("a.go") and ok("x/y/a.go") and not ok("vendor/a.go") and not ok("x/a_test.go") and not ok("a.gox")


def test_json_lines_skip_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1}\n\n{bad\n{"id":2}\n')
    assert sorted(r.id for r in IO.json_lines(spark, str(tmp_path / "a.jsonl"), "id long").collect()) == [1, 2]


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "2026-01-02.json").write_text('{"sessions": 3}')
    (tmp_path / "notes.json").write_text("{}")
    got = IO.daily_reports(spark, str(tmp_path), "date string, sessions long").collect()
    assert [(r.date, r.sessions) for r in got] == [("2026-01-02", 3)]
    assert IO.recent_files(spark, str(tmp_path), "*.json", F.to_timestamp(F.lit("2000-01-01"))).count() == 2
    IO.write_csv(spark.range(3), str(tmp_path / "csv"), "id")
    IO.append_json(spark.range(2), str(tmp_path / "j"))
    IO.append_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_files_are_replaced_in_one_step(spark, tmp_path):
    at = f"{tmp_path}/report.md"
    assert files.read_text(spark, at) is None
    files.write_text(spark, at, "one\n", 86_400_000)
    assert (tmp_path / "report.md").stat().st_mtime == 86_400
    files.write_lines(spark, at, ["two", "äöü"])
    assert files.read_text(spark, at) == "two\näöü\n"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.md"]


def test_tables_are_replaced_in_one_step(spark, tmp_path):
    at = str(tmp_path / "t")
    files.replace_table(spark.range(6), at)
    old = files.current_table(spark, at)
    files.replace_table(old.where("id > 2"), at)  # reads what it replaces
    assert sorted(r.id for r in files.current_table(spark, at).collect()) == [3, 4, 5] and old.count() == 6
    files.replace_table(files.current_table(spark, at).where("id > 3"), at)
    assert files.current_table(spark, at).count() == 2
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_pages_and_cursors_end_by_themselves(spark):
    pages = {0: [(1,), (2,)], 1: [(3,), (4,)], 2: [(5,)]}
    read = lambda kind, fetch, **o: kind("x", "item long", fetch)(o).reader(None)
    drain = lambda r: sorted(x for p in r.partitions() for (x,) in r.read(p))
    for stripes in (1, 2, 5):
        assert drain(read(IO.paged_source, lambda k: pages.get(k, []), pageSize="2", stripes=str(stripes))) == [1, 2, 3, 4, 5]
    follow = lambda c: (pages[int(c or 0)], str(int(c or 0) + 1) if int(c or 0) < 2 else None)
    assert drain(read(IO.cursor_source, follow)) == [1, 2, 3, 4, 5]
    assert drain(read(IO.cursor_source, follow, maxPages="2")) == [1, 2, 3, 4]
    assert drain(read(IO.cursor_source, follow, limit="3")) == [1, 2, 3]


def test_logs_and_paged_documents(spark, tmp_path):
    (tmp_path / "a.log").write_text("2026-01-02 03:04:05,678 did x\nno time did x\n2026-01-02 03:04:06,000 did y\n2026-01-01 00:00:00,000 did x\n")
    got = {r.category: str(r.last) for r in IO.log_last_match(spark, f"{tmp_path}/a.log", {"x": "did x", "z": "did z"}).collect()}
    assert got == {"x": "2026-01-02 03:04:05.678000"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\f \fthree")
    (tmp_path / "d" / "b.txt").write_text("broken")
    pages = lambda data: 1 / 0 if data == b"broken" else IO.form_feed_pages(data)
    assert [r.body for r in IO.paged_text(spark, f"{tmp_path}/d", pages).collect()] == ["--- Page 1 ---\none\n\n--- Page 3 ---\nthree"]
    for day, text in (("2026-01-01", '{"n": 1}'), ("2026-01-03", '{"n": 3}'), ("2026-01-04", "{bad"), ("2025-12-01", '{"n": 9}')):
        (tmp_path / f"{day}-p.json").write_text(text)
    assert sorted(r.n for r in IO.daily_logs(spark, str(tmp_path), "n long", 4, "2026-01-04", "-p").collect()) == [1, 3]


@pytest.mark.parametrize("automaton", [True, False])
def test_passages_are_found_whole(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(E, "ahocorasick", None)
    found = E.Passages([(1, "ab"), (2, "b c"), (3, "ab"), (4, "abcd")])
    assert found.within("xab cab") == {1, 2, 3} and found.within("") == set()
    docs = spark.createDataFrame([(1, "long passage here"), (2, None), (3, "long passage")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "long passage"), (8, "passage here"), (9, ""), (10, None)], "item_id long, text string")
    for chunk in (4_000_000, 12):
        assert sorted(tuple(r) for r in E.holders(docs, items, chunk=chunk).collect()) == [(1, 7), (1, 8), (3, 7)]


def test_longest_common_subsequence():
    r = random.Random(9)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            past, row = row, [0] * (len(b) + 1)
            for k, d in enumerate(b, 1):
                row[k] = past[k - 1] + 1 if c == d else max(past[k], row[k - 1])
        assert M.longest_common(a, M.letter_places(b), len(b)) == row[-1]


def test_ratio_bounds_lose_nothing(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdef ") for _ in range(120))
    edit = lambda: "".join(c if r.random() > 0.15 else r.choice("abcxyz ") for c in base)[: r.randrange(60, 120)]
    rows_ = [(edit(), edit()) for _ in range(300)] + [("", ""), ("a", "")]
    df = spark.createDataFrame(rows_, "a string, b string")
    exact = [x.v for x in df.select(M.sequence_ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    some = [x.v for x in df.select(M.sequence_ratio(F.col("a"), F.col("b"), 0.7).alias("v")).collect()]
    assert all((v is None and e <= 0.7) or v == e for v, e in zip(some, exact, strict=True)) and None in some
    assert {tuple(x) for x in M.close_in_length(df, F.col("a"), F.col("b"), 0.7).collect()} >= {p for p, e in zip(rows_, exact, strict=True) if e > 0.7}


def test_unified_diff(spark):
    assert one(spark, M.unified_diff(F.lit("a\nb"), F.lit("a\nc"))) == "--- stored\n+++ current\n@@ -1,2 +1,2 @@\n a\n-b\n+c"
    assert one(spark, M.unified_diff(F.lit("a"), F.lit("a"))) == ""


def test_sorted_queries_are_in_order(spark):
    from mnemosail import plans

    keys = {"sort_reason_counts": lambda r: (-r.n, r.category), "sort_pending_desc": lambda r: (-r.n, r.bank), "sort_csv": lambda r: (r.day, r.raw_server), "sort_file_mtime": lambda r: (r.mtime, r.page_id), "agg_pending_by_project": lambda r: (-r.n, r.project)}
    for name, key in keys.items():
        got = plans.QUERIES[name](spark, f"{DATA}/sf0.001").collect()
        assert got == sorted(got, key=key) and len(got) > 1, name


def test_replace_partitions(spark, tmp_path):
    at = str(tmp_path / "t")
    IO.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), at, "d")
    IO.replace_partitions(spark.createDataFrame([(9, "b")], "v int, d string"), at, "d")
    assert sorted((r.v, r.d) for r in spark.read.parquet(at).collect()) == [(1, "a"), (9, "b")]


def test_debounce_keeps_counting_while_it_waits():
    out, total, fired = P.count_steps([0, 10, 20, 5000, 20_000], [5, 3, 3, 1, 1], 0, None, 5, 14_400)
    assert [f for *_, f in out] == [True, False, False, False, True] and out[3][1] == 7 and fired == 20_000 and total == 0


def test_streamed_counter_equals_the_batch_one(spark, tmp_path):
    r = random.Random(6)
    hits = [(b, t, 1) for b in range(3) for t in sorted(r.sample(range(60_000), 80))]
    df = spark.createDataFrame(hits, "bank long, at long, n long")
    want = sorted(tuple(x) for x in P.debounced(df).collect())
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (df.where("at < 20000"), df.where("at >= 20000")):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema("bank long, at long, n long").parquet(src)
        P.run_available(P.stream_debounced(stream), lambda b, n: b.write.mode("append").parquet(out), f"{tmp_path}/state")
    assert sorted((x.bank, x.at, x.total, x.fires) for x in spark.read.parquet(out).collect()) == want


def test_size_gate(spark):
    batch = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "t long, size long")
    assert sorted(r.t for r in P.size_gate(batch, spark.createDataFrame([(1, 10), (2, 9)], "t long, recorded long")).collect()) == [2, 3]


def test_marks(spark):
    m = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 0)], "t long, raw_idx long")
    marks = spark.createDataFrame([(1, 3), (2, 1), (3, 4)], "t long, message_count long")
    assert sorted((r.t, r.raw_idx) for r in P.new_messages(m, marks).collect()) == [(1, 3), (1, 4)]
    assert {r.t: r.message_count for r in P.next_marks(m, marks).collect()} == {1: 5, 2: 1, 3: 4}


def test_stream_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    grow = lambda n: spark.createDataFrame([(1, k) for k in range(n)], "t long, raw_idx long").coalesce(1).write.mode("append").parquet(str(src))
    run = lambda: P.run_available(P.stream_new_messages(P.watch(spark, str(src), "t long, raw_idx long", "parquet")), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "state"))
    grow(3)
    run()
    grow(5)  # the whole transcript again, longer
    run()
    assert sorted(r.raw_idx for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_windows_travel_in_small_batches(spark):
    import pandas as pd

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        docs = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(300))).alias("id"), F.repeat(F.lit("line \n"), 20_000).alias("text")).coalesce(1)
        spans = C.fixed_windows(F.col("text"))
        assert int(spark.conf.get(key)) <= 4 << 20

        @F.pandas_udf("long")
        def together(s: pd.Series) -> pd.Series:
            return pd.Series([len(s)] * len(s))

        got = docs.select(F.size(spans).alias("n"), together(F.col("text")).alias("k")).agg(F.max("k").alias("k"), F.count("*").alias("rows"), F.min("n").alias("n")).first()
    finally:
        spark.conf.set(key, before)
    # 36 MB of texts; a batch may pass its bound by one text
    assert got.k <= 36 and got.rows == 300 and got.n == len(C.window_spans("line \n" * 20_000, 800, 200))


def test_rest_does_not_import_llm():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "mnemosail"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text()), p
