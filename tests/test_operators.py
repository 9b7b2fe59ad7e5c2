from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import scores, text, times, urls
from tidewire.models import operators as models
from tidewire.operators import dedup, feeds, select, store
from tidewire.sources import parse
from tidewire.streaming import rounds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_normalize_url(spark):
    cases = {
        "HTTPS://www.Example.com/a/?utm_source=x&id=5#top": "https://example.com/a/?id=5",
        "https://example.com/": "https://example.com/",
        "https://example.com/a/": "https://example.com/a",
        "https://example.com": "https://example.com/",
        " Not A Url ": "not a url",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, urls.normalize_url(F.lit(raw))) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://x/202510/t20251013_1.html", "2025-10-13T01:00:00.000Z"),
        ("https://x/2025/2/31/a", "2025-03-03T01:00:00.000Z"),
        ("https://x/20251301/", None),
        ("https://x/a", None),
    ],
)
def test_date_from_url(spark, url, want):
    assert one(spark, urls.published_from_url(F.lit(url))) == want


def test_titles(spark):
    assert one(spark, text.normalize_title(F.lit("【早报】Apple 发布 “新品”！ [独家]"))) == "apple发布新品"
    assert one(spark, text.dice(F.lit("abcd"), F.lit("abcd"))) == 1.0
    assert one(spark, text.dice(F.lit("a"), F.lit("b"))) == 0.0
    assert one(spark, text.digits_conflict(F.lit("v4 of 2"), F.lit("v5"))) is True
    assert one(spark, text.digits_conflict(F.lit("none"), F.lit("v5"))) is False


def test_incident_words(spark):
    assert one(spark, text.is_incident(F.lit("微软Azure宕机"), F.lit(""), F.lit("x"))) is True
    assert one(spark, text.is_incident(F.lit("metadata outage"), F.lit(""), F.lit("x"))) is False
    assert one(spark, text.is_incident(F.lit("outage"), F.lit(""), F.lit("The Register"))) is True


def test_shell_and_material(spark):
    assert one(spark, text.is_shell(F.lit("页面不存在"))) is True
    long = "long words in a line that is long enough to be read " * 8
    assert one(spark, text.is_shell(F.lit("页面不存在\n" + long))) is True  # a strong marker decides alone
    assert one(spark, text.is_shell(F.lit("404 not found\n" + long))) is True
    assert one(spark, text.is_shell(F.lit("环境异常\n" + long))) is True
    assert one(spark, text.is_shell(F.lit(long + "环境异常" + long))) is False  # a weak one only on a short line
    assert one(spark, text.is_shell(F.lit(long))) is False
    assert one(spark, text.is_shell(F.lit(" \u3000\n"))) is True
    assert one(spark, text.is_shell(F.lit(None).cast("string"))) is True
    assert one(spark, text.is_shell(F.lit("扫码关注我们\n" * 60 + "short text"))) is True  # navigation is not read
    assert one(spark, text.is_shell(F.lit("short lines\n" * 60))) is False
    assert one(spark, text.pick_material(F.lit("x" * 250), F.lit(""), F.lit("t"))["from"]) == "content"
    assert one(spark, text.pick_material(F.lit("x"), F.lit("y" * 350), F.lit("t"))["from"]) == "snippet"
    assert one(spark, text.pick_material(F.lit("x"), F.lit("title" + "y" * 220), F.lit("title"))) is None
    assert one(spark, text.pick_material(F.lit("x"), F.lit("y" * 220 + "title"), F.lit("title"))) is None
    assert one(spark, text.pick_material(F.lit("x"), F.lit("y" * 220), F.lit("y" * 300))) is None
    assert one(spark, text.pick_material(F.lit("x"), F.lit("title" + "y" * 320), F.lit("title")))["from"] == "snippet"
    assert one(spark, text.pick_material(F.lit("x"), F.lit("y" * 350), F.lit("y" * 350))) is None


def test_spread_and_sub_scores(spark):
    assert one(spark, scores.spread(F.lit(0), F.lit(1), F.lit(80), F.lit(89))) == 85
    assert [one(spark, scores.spread(F.lit(i), F.lit(3), F.lit(80), F.lit(89))) for i in range(3)] == [89, 84, 80]
    assert one(spark, scores.sub_scores(F.lit(99.0), F.lit(-3.0), F.lit(None).cast("double"), F.lit(7))) == 40
    assert one(spark, scores.sub_scores(*[F.lit(None).cast("double")] * 3, F.lit(7))) == 7


def test_relative_time(spark):
    now = F.lit("2024-01-20 03:00:00").cast("timestamp")
    at = lambda s: one(spark, F.date_format(times.relative_time(F.lit(s), now), "yyyy-MM-dd HH:mm"))
    assert at("5分钟前") == "2024-01-20 02:55"
    assert at("昨天 08:30") == "2024-01-19 00:30"
    assert at("前天") == "2024-01-18 04:00"
    assert at("someday") is None


def test_cascade_small(spark):
    rows = spark.createDataFrame([("d", i, 0, i, i) for i in range(6)], "day string, id long, tier int, rank long, ord long")
    got = {r.id: (r.final_tier, r.demoted_from, r.score) for r in select.cascade(rows).collect()}
    assert got == {0: (0, None, 92), 1: (1, 0, 89), 2: (1, 0, 84), 3: (1, 0, 80), 4: (2, 0, 79), 5: (2, 0, 70)}


def test_cascade_against_simulation(spark):
    import random

    r = random.Random(5)
    data = [("d", i, r.randrange(5), r.randrange(9), i) for i in range(60)]
    bins = {t: sorted([x for x in data if x[2] == t], key=lambda x: (x[3], x[4])) for t in range(5)}
    for t, seats in ((0, 1), (1, 3)):
        over, bins[t] = bins[t][seats:], bins[t][:seats]
        bins[t + 1] = sorted(bins[t + 1] + over, key=lambda x: (x[3], x[4]))
    want = {x[1]: t for t, xs in bins.items() for x in xs}
    got = select.cascade(spark.createDataFrame(data, "day string, id long, tier int, rank long, ord long")).collect()
    assert {x.id: x.final_tier for x in got} == want


def test_replacements_stop_at_first_failure(spark):
    c = spark.createDataFrame([("d", 1, 90), ("d", 2, 70), ("d", 3, 69)], "date_key string, id long, ai_score long")
    v = spark.createDataFrame([("d", 11, 60), ("d", 12, 70), ("d", 13, 71)], "date_key string, id long, ai_score long")
    assert [tuple(r) for r in select.replacements(c, v).collect()] == [("d", 1, 11)]


def test_featured_budget_in_list_order(spark):
    rows = spark.createDataFrame([("d", i, s, i) for i, s in enumerate([81, 79, 90, 99])], "date_key string, id long, ai_score long, ord long")
    assert [r.id for r in select.mark_featured(rows, budget=2, first_share=1.0).where("featured = 1").orderBy("id").collect()] == [0, 2]
    assert [r.id for r in select.mark_featured(rows).where("featured = 1").collect()] == [0]  # a quarter, one at least


def test_featured_in_later_rounds(spark):
    data = [("d", 1, 90, 1, "a", "retro", "2024-01-30 20:00:00"), ("d", 2, 88, 2, "突发 news", "new", None), ("d", 3, 86, 3, "b", "new", "2024-01-30 20:00:00"), ("d", 4, 95, 4, "c", "new", "2024-01-30 20:00:00"), ("d", 5, 99, 5, "e", "new", "2024-01-29 20:00:00"), ("d", 6, 84, 6, "f", "new", "2024-01-30 20:00:00")]
    rows = spark.createDataFrame(data, "date_key string, id long, ai_score long, ord long, title string, newsness string, published_at string")
    context = spark.createDataFrame([("d", 9, 4, 85)], "date_key string, existing_count long, existing_featured long, featured_min_score long")
    got = {r.id: (r.featured, r.breaking) for r in select.mark_featured(rows, context, now="2024-01-31 00:00:00").collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 1), 5: (0, 0), 6: (0, 0)}


def _by_hand(rows, stored):
    """The day's selection, one row after the other."""
    rows = sorted(rows, key=lambda r: (-r["ai_score"], r["id"]))
    policy = [r for r in rows if r["source_type"] == "official" and r["category"] == "policy" and r["ai_score"] >= 70][:2]
    incidents = [r for r in rows if r["suspected"] and r["ai_score"] >= 56 and r not in policy][:3]
    out = {r["id"]: ("policy", None) for r in policy} | {r["id"]: ("incident", None) for r in incidents}
    pool = [r for r in rows if r["id"] not in out]
    room = max(0, 20 - len(stored))
    if not room:
        victims = sorted((v for v in stored if v["category"] != "policy" and v["is_featured"] != 1), key=lambda v: (v["ai_score"], v["id"]))
        used = []
        for c in pool:
            free = [v for v in victims if v["id"] not in used and v["ai_score"] < c["ai_score"]]
            if len(used) < 5 and free:
                used.append(free[0]["id"])
                out[c["id"]] = ("replace", free[0]["id"])
        return out | {r["id"]: ("breaking", None) for r in [r for r in pool if r["ai_score"] >= 85 and r["id"] not in out][:2]}
    least = 70 if len(stored) >= 10 else 65
    chosen = [r for r in pool if r["ai_score"] >= least][:room]
    fill = [r for r in pool if 56 <= r["ai_score"] < least][: max(0, min(10 - len(stored) - len(chosen), 5))]
    return out | {r["id"]: ("regular", None) for r in chosen} | {r["id"]: ("backfill", None) for r in fill}


def test_quota_against_one_row_after_the_other(spark):
    import random

    r = random.Random(9)
    make = lambda day, i: {"id": i, "date_key": day, "ai_score": r.choice([40, 55, 56, 60, 64, 65, 69, 70, 75, 84, 85, 86, 95]), "category": r.choice(["policy", "company", "infra"]), "source_type": r.choice(["official", "media"]), "suspected": r.random() < 0.15, "is_featured": int(r.random() < 0.2)}
    kind = "id long, date_key string, ai_score long, category string, source_type string, suspected boolean, is_featured int"
    days = {f"d{k}": ([make(f"d{k}", 1000 * k + i) for i in range(r.choice([0, 3, 12, 40]))], [make(f"d{k}", 1000 * k + 500 + i) for i in range(n)]) for k, n in enumerate([0, 0, 2, 5, 9, 10, 14, 19, 20, 20, 25, 30])}
    new = spark.createDataFrame([x for a, _ in days.values() for x in a], kind)
    stored = spark.createDataFrame([x for _, b in days.values() for x in b], kind)
    got = {x.id: (x.channel, x.victim) for x in select.quota(new, stored).collect()}
    assert got == {i: x for a, b in days.values() for i, x in _by_hand(a, b).items()}


def test_policy_floor_counts_stored_rows_and_urls(spark):
    kind = "id long, date_key string, ai_score long, category string, source_url string"
    rows = spark.createDataFrame([(1, "d", 60, "policy", "u1"), (2, "d", 58, "policy", "u2"), (3, "d", 57, "policy", ""), (4, "e", 90, "policy", "u4"), (5, "f", 55, "policy", "u5")], kind)
    selected = spark.createDataFrame([(9, "d", 80, "company", "u1"), (8, "e", 80, "policy", "u8")], kind)
    full = spark.createDataFrame([("e", i) for i in range(19)], "date_key string, id long")
    assert sorted(x.id for x in select.policy_floor(rows, selected, full).collect()) == [2, 3]
    assert sorted(x.id for x in select.policy_floor(rows, selected).collect()) == [2, 3, 4]


def test_related_against_brute_force(spark):
    import math
    import random

    r = random.Random(10)
    tag = lambda letter, n, most: [f"{letter}{r.randrange(n)}" for _ in range(r.randrange(most + 1))]
    rows = [(i, f"2024-01-{r.randrange(1, 29):02d}" if r.random() < 0.95 else "unknown", r.choice(["company", "noise", "infra", "infra"]), r.choice(["", f"e{r.randrange(12)}"]), tag("c", 6, 3), tag("P", 4, 2), [*tag("k", 9, 3), "AI"]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, date_key string, category string, event_norm string, companies array<string>, people array<string>, keywords array<string>")
    norm = lambda vs: {v.strip().lower() for v in vs} - {"ai", ""}
    kept = [(i, int(d[-2:]), e, norm(c + p), norm(k)) for i, d, cat, e, c, p, k in rows if cat != "noise" and d != "unknown"]
    want = set()
    for i, day, event, subj, topic in kept:
        cands = [x for x in kept if day - 30 <= x[1] < day]
        df_of = lambda v: sum(v in x[3] | x[4] for x in cands)  # noqa: B023, E731
        idf = {v: math.log((len(cands) + 1) / (df_of(v) + 1)) + 0.3 for v in subj | topic}
        found = []
        for j, d2, e2, s2, t2 in cands:
            s, t = subj & s2, topic & t2
            kind = 0 if event and e2 == event else 1 if s and t else 2 if len(t) >= 2 else None
            if kind is not None:
                found.append((kind, -round(sum(2 * idf[v] for v in t) + sum(idf[v] for v in s), 6), -d2, j))
        want |= {(i, f[3], f[0], n + 1) for n, f in enumerate(sorted(found)[:3])}
    assert {tuple(x) for x in feeds.related(df).collect()} == want


def test_leaders_are_not_transitive(spark):
    rows = spark.createDataFrame([("r", 1, "abcdefgh", 90), ("r", 2, "abcdefzz", 80), ("r", 3, "cdefzzyy", 70), ("r", 4, "abcd", 60)], "round string, id long, name string, score long")
    assert {r.id: r.leader for r in dedup.leader_clusters(rows, 0.7).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


@pytest.mark.parametrize("sizes", [{}, {"COMMON": 1, "HASHED": 1, "COPIES": 3, "CHUNK": 8, "SPREAD": 2}])
def test_similar_titles_against_brute_force(spark, monkeypatch, sizes):
    """Copies, ids that come twice, wide alphabets, and chunks and lists of a few rows."""
    import random

    for k, v in sizes.items():
        monkeypatch.setattr(dedup, k, v)
    r = random.Random(4)
    letters = ["abcd ", "".join(chr(0x4E00 + i) for i in range(60)), "ab12 "]
    seeds = ["".join(r.choice(x) for _ in range(r.randrange(10, 40))) for x in letters for _ in range(8)]
    title = lambda: "".join(c if r.random() < 0.9 else r.choice("ab1") for c in r.choice(seeds))
    rows = [(r.randrange(200), r.choice(["x", "x", "y", None]), r.choice([title(), *seeds[::8], None])) for _ in range(260)]
    rows += [(None, "x", seeds[0]), *((300 + i, "x", "a" * 16) for i in range(20)), (400, "x", "a" * 17), (401, "x", "ab" * 8)]
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    kept = [(i, b, grams(t), set(re.findall("[0-9]+", t))) for i, b, t in rows if i is not None and b and t and len(t) >= 16]
    want = []
    for i, b, g, x in kept:
        for j, c, h, y in kept:
            d = 2 * len(g & h) / (len(g) + len(h))
            if b == c and i < j and d >= 0.55 and not (x and y and x != y):
                want.append((i, j, round(d, 6)))
    df = spark.createDataFrame(rows, "id long, block string, title string")
    assert sorted((x.a, x.b, round(x.dice, 6)) for x in dedup.similar_titles(df).collect()) == sorted(want)


def test_similar_titles_shuffle_no_pairs(spark):
    """What is shuffled grows with the titles, not with the pairs: 1,500 copies are a million pairs."""
    store_ = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    written = lambda: sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store_.stageList(None, False, False, quantiles, None)))
    rows = spark.range(1500).select("id", F.lit("x").alias("block"), F.lit("the same title of all rows").alias("title"))
    before = written()
    assert dedup.similar_titles(rows).count() == 1500 * 1499 // 2
    assert written() - before < 1_000_000


def test_plans_hold_at_scale(spark):
    """No cross product on big sides, no UDF, and pushed filters in the flagship query."""
    from tidewire import catalog

    plan = catalog.QUERIES["W01_catchup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "WindowGroupLimit" in plan
    plan = feeds.related(catalog_articles(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def catalog_articles(spark):
    from tidewire.plans.adapters import articles

    return articles(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("partitions", [1, 8])
def test_partition_count_does_not_matter(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(tuple(r) for r in feeds.related(catalog_articles(spark)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    test_partition_count_does_not_matter.seen = getattr(test_partition_count_does_not_matter, "seen", got)
    assert got == test_partition_count_does_not_matter.seen


def test_guarded_swap_refuses(spark):
    with pytest.raises(ValueError, match="refused"):
        store.guarded_swap(spark.range(10), spark.range(4), spark.range(0), "id")
    assert store.guarded_swap(spark.range(10), spark.range(5), spark.range(1), "id").count() == 4


def test_charsets():
    assert parse.decode_bytes("こんにちは".encode("shift_jis"), "Shift-JIS") == ("shift_jis", "こんにちは")
    assert parse.decode_bytes('<meta charset="gb2312">中文'.encode("gbk")) == ("gbk", '<meta charset="gb2312">中文')
    assert parse.decode_bytes(b"\xef\xbb\xbfx") == ("utf-8", "x")
    assert parse.decode_bytes("日本語のページ".encode("euc-jp"))[0] in ("shift_jis", "euc-jp")


def test_feeds_and_lists(spark):
    rss = "<rss><channel><item><title>One headline</title><link>https://a/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 +0800</pubDate><description>&lt;b&gt;x&lt;/b&gt; y</description></item></channel></rss>"
    page = '<ul><li><a href="./t20240115_9.html" title="A long enough title">A long</a><span>2024-01-15</span></li><li><a href="/x">no date in link</a></li></ul>'
    answer = json.dumps({"data": {"list": [{"title": "<em>Policy</em> text", "policyurl": "/p/1", "pubdate": 1705284000000}]}})
    rows = [("feed", "F", "https://a/", rss), ("beijing", "B", "https://b/list/", page), ("zhejiang", "Z", "https://z/", answer), ("nobody", "N", "https://n/", ""), ("zhejiang", "Bad", "https://z/", "{broken")]
    fetched = spark.createDataFrame([(k, n, u, "policy", "zh", "official", b, "2024-01-20 00:00:00") for k, n, u, b in rows], "scraper string, name string, url string, category string, language string, source_type string, body string, now string")
    got = {r.source_name: r for r in parse.parse_pages(fetched).collect()}
    assert got["F"].published_at == "2024-01-15T02:00:00.000Z" and got["F"].content_snippet == "x y"
    assert got["B"].source_url == "https://b/list/t20240115_9.html" and got["B"].published_at == "2024-01-15T01:00:00.000Z"
    assert got["Z"].title == "Policy text" and got["Z"].published_at == "2024-01-15T02:00:00.000Z"
    assert got["N"].error == "no scraper nobody" and "Bad" not in got


def test_runs_of_articles():
    items = [{"kind": k} for k in ["Article", "Article", "Ad", "Article"]]
    assert [len(x) for x in parse.segments(items)] == [2, 1]


def test_loose_answers():
    assert models.duplicate_indexes('```json\n{"dup": ["B1", 3]}\n```') == [1, 3]
    assert models.duplicate_indexes("{dup: [2]}") == [2]
    assert models.duplicate_indexes("nothing here") == []
    assert models.duplicate_pairs('{"pairs": [{"b": "B2", "a": "A7"}]}') == [(2, 7)]


class Broken:
    def ask(self, prompt):
        raise RuntimeError("down")


def test_failing_service_is_open(spark):
    rows = spark.createDataFrame([(1, "t")], "id long, title string")
    assert models.score(rows, Broken).first().impact is None
    assert models.verdicts(rows, Broken).first().verdict == "new"


def test_rounds_are_idempotent(spark, tmp_path):
    schema = "source_url string, title string, published_at string, source_type string, window_days int"
    (tmp_path / "in").mkdir()
    now = lambda: "2024-01-20 00:00:00"

    def put(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def go():
        rounds.run_rounds(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "cp"), now).awaitTermination()
        return sorted(r.url_norm for r in spark.read.parquet(str(tmp_path / "store")).collect())

    row = lambda u, at: {"source_url": u, "title": "x", "published_at": at, "source_type": "media"}
    put(1, [row("https://a/1?utm_source=z", "2024-01-19T23:00:00Z"), row("https://a/1", "2024-01-19T22:00:00Z"), row("https://a/old", "2024-01-10T00:00:00Z"), row("https://a/undated", "")])
    assert go() == ["https://a/1", "https://a/undated"]
    put(2, [row("https://a/1", "2024-01-19T23:00:00Z"), row("https://a/2", "2024-01-19T23:00:00Z")])
    assert go() == ["https://a/1", "https://a/2", "https://a/undated"]
    assert go() == ["https://a/1", "https://a/2", "https://a/undated"]


def test_special_lists():
    from datetime import datetime, timezone

    source = {"name": "n", "url": "https://x/", "now": datetime(2024, 1, 20, 3, tzinfo=timezone.utc)}
    rows = parse.PARSERS["jiangsu"]("<record><![CDATA[<li><a href='/a'>A long title</a>2024 - 01 - 15</li>]]></record>", source)
    assert rows[0]["published_at"] == "2024-01-15T01:00:00.000Z"
    rows = parse.PARSERS["msit"]("<rss><item><title>News</title><link>u</link><pubDate>2024.1.5</pubDate></item></rss>", source)
    assert rows[0]["published_at"] == "2024-01-05T00:00:00.000Z"
    rows = parse.PARSERS["sdaia"]('<r><site ID="7" Title="Some title" Date="1/15/2024 1:00"/></r>', source)
    assert (rows[0]["source_url"], rows[0]["published_at"]) == ("https://x/?id=7", "2024-01-15T06:00:00.000Z")
    card = '<div class="text_box"><h4><a href="https://x/2024/01/9.html">A headline here</a></h4><p>short</p><span class="time">昨天 08:30</span></div>'
    rows = parse.PARSERS["qbitai"](card, source)
    assert (rows[0]["published_at"], rows[0]["content_snippet"]) == ("2024-01-19T00:30:00.000Z", "A headline here")
    edge = lambda kind, t: {"node": {"content": {"__typename": kind, "title": t, "path": "/" + t, "published_at": "2024/1/15 10:00:00"}}}
    body = json.dumps({"data": {"timelines": {"edges": [edge("Article", "one"), edge("Ad", "ad"), edge("Article", "two")]}}})
    assert [(r["title"], r["published_at"]) for r in parse.PARSERS["jiqizhixin"](body, source)] == [("one", "2024-01-15T02:00:00.000Z"), ("two", "2024-01-15T02:00:00.000Z")]


def test_two_level_scan(spark):
    listed = spark.createDataFrame([("s", i, f"u{i}") for i in range(20)], "source_name string, ord long, source_url string")
    details = spark.createDataFrame([("u1", '<span class="post-time x">on 2024/1/5</span>'), ("u2", "<p>none</p>")], "url string, html string")
    got = {r.source_url: r.published_at for r in parse.with_details(listed, details).collect()}
    assert len(got) == 15 and got["u1"] == "2024-01-05T04:00:00.000Z" and got["u2"] is None


def test_feeds_cover_every_event(spark):
    from tidewire import catalog
    from tidewire.plans.adapters import articles

    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["S01_feeds"](spark, sf).groupBy("source_name").agg(F.sum("n").alias("n")).collect()
    want = articles(spark, sf).groupBy("source_name").count().collect()
    assert {x["source_name"]: x["n"] for x in got} == {x["source_name"]: x["count"] for x in want}


def test_whole_queries_cover_every_event(spark):
    from tidewire import catalog

    sf = "/root/testdata/sf0.01"
    ids = {x[0] for x in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    got = {n: [x[0] for x in catalog.QUERIES[n](spark, sf).collect()] for n in ("J09_valid_pairs", "D05_group_merge", "S30_probe_items", "F45_spread", "J16_not_in_store")}
    for n in ("J09_valid_pairs", "S30_probe_items", "F45_spread"):
        assert sorted(got[n]) == sorted(ids), n
    assert sorted(i // 4 for i in got["D05_group_merge"]) == sorted({i // 4 for i in ids})
    assert 0 < len(got["J16_not_in_store"]) <= sum(i % 10 == 0 for i in ids)


def test_grounding_reads_the_whole_text(spark, tmp_path):
    import re

    from tidewire import catalog

    long = "plain words " * 300 + "then Zephyr9 and Quartz7 close"
    spark.createDataFrame([(1, long), (2, "short Alpha1"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.tokens, x.grounded) for x in catalog.QUERIES["F30_grounding"](spark, str(tmp_path)).collect()}
    brute = {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", long) if re.search("[A-Z]", w)}
    assert got[1] == (len(brute), True) and got[2] == (1, True)


def test_scrape_health_names_the_gravest_thing(spark):
    from tidewire.operators import intake

    kind = "thrown string, error string, matched int, status int, n int, fresh int"
    rows = [("boom", "x", 0, 503, 0, 0), (None, "x", 0, 503, 0, 0), (None, None, 0, 503, 0, 0), (None, None, 0, None, 0, 0), (None, None, 4, 503, 4, 4), (None, None, None, 200, 0, 0), (None, None, 5, 200, 5, 0), (None, None, 5, 200, 5, 2), (None, None, None, None, 3, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    got = [r.e for r in df.withColumn("e", intake.scrape_health(*(F.col(c) for c in ("thrown", "error", "matched", "status", "n", "fresh")))).orderBy("i").collect()]
    assert [g and g[: len(w)] for g, w in zip(got, ["SCRAPER_THROW boom", "SCRAPER_ERROR x", "PARSED_ZERO http=503", "PARSED_ZERO http=n/a", "HTTP 503", "ZERO_NO_META", "FILTERED_ALL matched=5"], strict=False)] == ["SCRAPER_THROW boom", "SCRAPER_ERROR x", "PARSED_ZERO http=503", "PARSED_ZERO http=n/a", "HTTP 503", "ZERO_NO_META", "FILTERED_ALL matched=5"]
    assert got[7:] == [None, None]


def test_retry_queue_shelves_and_holds(spark):
    from tidewire.operators import intake

    queue = spark.createDataFrame([("u1", "missing_body", None), ("u2", "missing_body", 2), ("https://www.politico.com/x", "HTTP 403", 1), ("u4", "ungrounded_summary:x", 0), ("u5", "missing_body", 3), ("u6", "timeout", 1)], "source_url string, reason string, attempts int")
    clean = spark.createDataFrame([("u4",), ("u6",), ("u5",)], "source_url string")
    got = {r.source_url: (r.state, r.attempts) for r in intake.retry(queue, clean).collect()}
    assert got == {"u1": ("queued", 1), "u2": ("shelved", 3), "https://www.politico.com/x": ("shelved", 3), "u4": ("held", 1), "u5": ("shelved", 3), "u6": ("released", 1)}


def test_feeds_that_were_decoded_wrongly_are_refused(spark):
    body = "<rss><channel><item><title>" + "\ufffd" * 60 + "</title><link>u</link></item></channel></rss>"
    fetched = spark.createDataFrame([("feed", "s", "https://x/", "c", "l", "t", body, "2024-01-20 00:00:00")], "scraper string, name string, url string, category string, language string, source_type string, body string, now string")
    got = parse.parse_pages(fetched).collect()
    assert len(got) == 1 and got[0].title is None and "U+FFFD" in got[0].error
