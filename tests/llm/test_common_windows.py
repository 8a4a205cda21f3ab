"""op10 with windows that many items share, and links of op6 without a scheme."""

import random
import time

from pyspark.sql import functions as F

from mnemosail.llm import common, decontam, url_filter


def prose(seed, n, vocab=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def matches(bench, texts):
    memo = common.Memo(decontam.code)
    return [bench.matches(t, memo) for t in texts]


def test_common_windows_lose_nothing():
    opening, long_opening = "read the text below and choose the best of the answers", prose(1, 30)
    items = [(k, f"{opening} {prose(100 + k, 6 + k % 40)}") for k in range(60)] + [(100 + k, f"{long_opening} {prose(500 + k, 50)}") for k in range(50)]
    items += [(200 + k, opening + " one two three four") for k in range(40)] + [(300, opening), (301, f"{prose(7, 20)} {opening} {prose(8, 20)}")]
    texts = [t for _, t in items] + [f"{prose(9, 50)} {opening} {prose(10, 50)}", f"x {long_opening} y", opening, f"{items[5][1]} {items[70][1]}", items[3][1].replace("best of", "best new of"), " ".join(items[30][1].split()[:24])]
    rare = decontam.Benchmark(items, decontam.Config(common=4))
    assert matches(rare, texts) == matches(decontam.Benchmark(items, decontam.Config(common=10**9)), texts)
    assert len(rare.tables[0].more[0])


def test_a_common_opening_costs_little():
    opening = "please answer the following question about the passage in one word"
    bench = decontam.Benchmark([(k, f"{opening} {prose(k, 30)}") for k in range(8000)], decontam.Config())
    memo, texts = common.Memo(decontam.code), [f"{opening} {prose(10**6, 400)}", prose(10**6 + 1, 411)]
    took = []
    for t in texts:
        bench.matches(t, memo)
        began = time.perf_counter()
        for _ in range(20):
            assert bench.matches(t, memo) == []
        took.append(time.perf_counter() - began)
    assert took[0] < 3 * took[1]
    assert [m[0] for m in bench.matches(f"so {opening} {prose(77, 30)} end", memo)] == [77]


def test_shares_of_many_items():
    items = [decontam.verbatim(decontam.TOKEN.findall(prose(k, 12 + k % 30)), common.Memo(decontam.code)) for k in range(16_000)]
    table = decontam.Table(items, decontam.Config())
    began = time.perf_counter()
    share = table.share()
    assert time.perf_counter() - began < 1 and (share == 1).all()
    # against one item at a time
    some = decontam.Benchmark([(k, "Tom has 3 red pens and Ann 5. " * (k % 3 + 1) + prose(k, k % 9)) for k in range(50)], decontam.Config()).tables[0]
    for k, t in enumerate(some.items):
        own = [s for i, s in [*zip(some.item, some.start, strict=True), *zip(*some.more[1:], strict=True)] if i == k]
        hit = {e for s in own for e in range(s, s + 8)}
        assert some.share()[k] == sum(t.end[e] - t.at[e] for e in hit) / (t.end - t.at).sum()


def test_tiny_items_are_reported_but_drop_nothing(spark):
    bench = spark.createDataFrame([(1, "7"), (2, "Is it 7?"), (3, "What is 12 + 5?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "7 apples"), (2, "is it 7 now"), (3, "so what is 12 + 5"), (4, "none")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1), (2, 1), (2, 2), (3, 3)}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {1, 2, 4}


def test_links_without_a_scheme(spark):
    page = """<a href="//Bad.org/x">a</a><a href=//good.net>b</a><a HREF='https://c.com/y'>c</a><a href="/local//d.com">d</a><a href="///e.com">e</a>"""
    df = spark.createDataFrame([(page,)], "html string").select(F.explode(F.regexp_extract_all("html", F.lit(url_filter.LINK), 1)).alias("url"))
    hosts = {r.h for r in df.select(url_filter.host_of(F.regexp_replace("url", "^//", "http://")).alias("h")).collect()}
    assert hosts == {"bad.org", "good.net", "c.com", ""}
