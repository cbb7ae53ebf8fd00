"""Values and invariants of single operators on hand-made rows."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.similarity import cosine, jaccard, source_sim, temporal_sim
from tidewatch.operators import behavior as H
from tidewatch.operators import clusters as E
from tidewatch.operators import dedupe as C
from tidewatch.operators import feeds as G
from tidewatch.operators import keywords as D
from tidewatch.operators import scoring as S
from tidewatch.operators import series as R
from tidewatch.sources import tables as A

NOW = "2024-01-31 00:00:00"
AT = dt.datetime(2024, 1, 31)


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_hashes(spark):
    rows = [("https://example.com/1", "T", "x" * 500), ("u", "T", "x" * 200 + "different")]
    got = T.with_hashes(spark.createDataFrame(rows, "url string, title string, body string")).collect()
    assert got[0].url_hash == "f2f9784142e4d11e"
    assert got[0].content_fp == got[1].content_fp and len(got[0].content_fp) == 16


def test_normalize(spark):
    texts = ["<p>Hello <b>world</b></p>", "AT&amp;T &lt;test&gt;", "Visit https://example.com for more info", "Contact user@example.com for help", "ㅋㅋㅋㅋㅋ 재밌다", "hello    world   test", None, ""]
    got = [r[0] for r in values(spark, [(t,) for t in texts], "t string", x=T.normalize_text(F.col("t")))]
    assert got[0] == "Hello world" and "&amp;" not in got[1] and "AT" in got[1] and "https" not in got[2] and "@" not in got[3]
    assert got[4] == "ㅋㅋ 재밌다" and got[5] == "hello world test" and got[6] == got[7] == ""
    assert len(values(spark, [("word " * 100,)], "t string", x=T.normalize_text(F.col("t"), 20))[0][0]) <= 20
    titles = values(spark, [("[속보] 대통령 긴급 발표",), ("(종합) 경제 성장률 발표",), ("Title (1162)",), ("Title 42",), ("Title (.txt)",)], "t string", x=T.normalize_title(F.col("t")))
    # square brackets are signs that the text pass has already made blanks
    assert [t[0] for t in titles] == ["속보 대통령 긴급 발표", "경제 성장률 발표", "Title", "Title", "Title"]


def test_spam(spark):
    texts = ["", "buy now", "http://a.b/c http://d.e/f http://g.h/i word", "call 010-1234-5678 or 02-123-4567 today please", "ABCDEFGHIJK normal short", "great deal!!! buy now!!! limited!!! offer!!!", "An ordinary news sentence about the weather in town.", None]
    got = T.classify_spam(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert got[0].is_spam and got[0].confidence == 1.0 and got[0].reasons == ["empty_content"] and got[7].is_spam
    for k, reason in ((1, "content_too_short"), (2, "high_url_ratio"), (3, "multiple_phone_numbers"), (4, "excessive_caps"), (5, "excessive_punctuation")):
        assert reason in got[k].reasons
    assert not got[6].is_spam and not got[6].reasons


def test_category(spark):
    words = [("sports", w, x) for w, x in (("축구", 1.5), ("야구", 1.5), ("선수", 1.0), ("경기", 1.0))] + [("economy", w, x) for w, x in (("주가", 1.5), ("코스피", 1.5), ("금리", 1.2), ("투자", 1.0))]
    d = spark.createDataFrame(words, "category string, keyword string, weight double")
    a = spark.createDataFrame([(1, "축구 월드컵 경기", "선수 리그 우승", "x"), (2, "주가 코스피 금리", "투자 증시", "x"), (3, "날씨", None, "weather")], "article_id int, title string, body string, category string")
    assert {r.article_id: r.category for r in T.infer_category(a, d).collect()} == {1: "sports", 2: "economy", 3: "weather"}


def test_questions_sentiment_traffic(spark):
    q = [r[0] for r in values(spark, [(t,) for t in ("What is trending now?", "How to grow on social media", "어떻게 트렌드를 분석하나요", "New product launch announcement", "", None)], "t string", x=T.is_question(F.col("t")))]
    assert q == [True, True, True, False, False, False]
    s = T.sentiment(spark.createDataFrame([("이 제품 정말 좋아요 최고입니다",), ("정말 나쁜 제품 최악이에요",), ("오늘 날씨는 보통입니다",), ("",)], "text string")).collect()
    assert [r.label for r in s] == ["positive", "negative", "neutral", "neutral"]
    n = [r[0] for r in values(spark, [(t,) for t in ("500000", "500,000+", "1,000,000+", "", "N/A", None)], "t string", x=A.traffic(F.col("t")))]
    assert n == [500000.0, 500000.0, 1000000.0, 0.0, 0.0, 0.0]


def test_similarity(spark):
    rows = [(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (None, ["a"])]
    assert [r[0] for r in values(spark, rows, "a array<string>, b array<string>", x=jaccard(F.col("a"), F.col("b")))] == [0.5, 0.0, 0.0]
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [-1.0, -2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])]
    assert [round(r[0], 9) for r in values(spark, rows, "a array<double>, b array<double>", x=cosine(F.col("a"), F.col("b")))] == [0, -1, 0, 0, 0]
    rows = [(AT, AT, "a", "a"), (AT, AT - dt.timedelta(days=7), "a", "b"), (None, AT, "", "b")]
    got = values(spark, rows, "a timestamp, b timestamp, c string, d string", x=temporal_sim(F.col("a"), F.col("b")), y=source_sim(F.col("c"), F.col("d")))
    assert got[0] == (1.0, 1.0) and got[1][0] < 0.1 and got[1][1] == 0 and got[2] == (0.0, 0.5)


SERIES = [
    ([10] * 10 + [100], 1.0, 1.0, 0.562183, 0.890546, "high"), ([10] * 5, 0.0, 1.0, 0.0, 0.35, "low"), ([10, 11, 9, 10.5, 9.5, 10], 0.5, 0.333333, 0.0, 0.316667, "low"), ([1, 2, 3, 4, 100], 1.0, 1.0, 0.343477, 0.835869, "high"),
    ([100, 200, 300, 1], 0.093793, 0.0, 0.133895, 0.070991, "end"), ([1, 2, 3, 4, 5], 0.872678, 1.0, 0.070711, 0.716749, "normal"), ([10] * 15 + [100, 200, 300], 1.0, 1.0, 1.0, 1.0, "mega"), ([1, 2], 0, 0, 0, 0, "end"), ([7], 0, 0, 0, 0, "end"),
]


def test_bursts(spark):
    rows = [(str(k), AT + dt.timedelta(seconds=60 * i), float(v)) for k, (vs, *_) in enumerate(SERIES) for i, v in enumerate(vs)]
    for order in (rows, rows[::-1]):
        got = {r.key: r for r in R.detect_burst(spark.createDataFrame(order, "key string, ts timestamp, value double").repartition(3)).collect()}
        for k, (_, z, p, c, score, level) in enumerate(SERIES):
            r = got[str(k)]
            assert (r.z_part, r.percentile_part, r.cusum_part, r.burst_score) == pytest.approx((z, p, c, score), abs=1e-5) and r.level == level


def test_momentum_growth_multiplier(spark):
    rows = [(0, 0, 0, 0.0), (5, 5, 24, 1.0), (0, 5, 24, 1.0), (1, 2, 24, 0.6), (1, 1, 0, 1.0)]
    assert [r[0] for r in values(spark, [r[:3] for r in rows], "a int, b int, c int", x=S.momentum_15m(F.col("a"), F.col("b"), F.col("c")))] == pytest.approx([r[3] for r in rows])
    rows = [(30, 2, None), (12, 10, 8), (5, 5, 5), (None, None, None), (1, None, None), (15, 9, None), (10, 0, None)]
    assert [r[0] for r in values(spark, rows, "a int, b int, c int", x=S.growth_type(F.col("a"), F.col("b"), F.col("c")))] == ["spike", "growth", "unknown", "unknown", "unknown", "growth", "spike"]
    assert [r[0] for r in values(spark, [(n,) for n in range(7)], "n int", x=S.source_multiplier(F.col("n")))] == [1.0, 1.0, 1.1, 1.2, 1.3, 1.5, 1.5]


def test_scores(spark):
    at = AT - dt.timedelta(minutes=30)
    got = values(spark, [(at, c) for c in ("breaking", "politics", "it", "other")] + [(AT + dt.timedelta(hours=1), "it")], "t timestamp, c string", x=S.freshness(F.col("t"), F.col("c"), NOW))
    assert [r[0] for r in got] == pytest.approx([4.978707, 30.119421, 54.881164, 22.313016, 100], abs=1e-5)
    schema = "published_at timestamp, category string, source_type string, article_count int, source_count int, social_signal double, keyword_importance double, burst_score double, velocity double"
    rows = S.trend_score(spark.createDataFrame([(AT, "x", "d", n, 1, 0.0, 0.0, 0.0, 0.0) for n in range(1, 11)] + [(AT, "x", "d", 20, 9, 99.0, 1.0, 1.0, 1.0)], schema), NOW).collect()
    assert [r.score for r in rows[:5]] == pytest.approx([8.84, 17.27, 26.70, 34.80, 43.22], abs=0.011)
    assert all(a.score < b.score for a, b in itertools.pairwise(rows[:10])) and rows[-1].score == 100


def test_status(spark):
    rows = [(90, 50, "steady", "exploding"), (85, None, "up", "exploding"), (75.5, 50, "steady", "exploding"), (56, 50, "steady", "rising"), (30, None, "rising", "rising"), (65, 70, "down", "peaked"), (66.5, 70, "steady", "peaked"), (40, 50, "steady", "declining"), (30, None, "down", "declining"), (50, 50, "steady", "stable"), (50, None, None, "stable"), (50, 0, "steady", "stable")]
    got = values(spark, [(float(a), None if b is None else float(b), c) for a, b, c, _ in rows], "a double, b double, c string", x=S.trend_status(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_seasonality_prediction(spark):
    day = dt.datetime(2023, 3, 8)
    cases = {"a": ([10, 11], 10.5, True), "b": ([2, 3], 50, False), "c": ([7, 7], 7, True), "d": ([5, 5], 10, False)}
    rows = [(k, day.replace(year=2021 + i) if i < 2 else day, float(v), i) for k, (past, last, _) in cases.items() for i, v in enumerate([*past, last])] + [("e", day, 1.0, 0)]
    got = {r.keyword: r.seasonal for r in R.seasonality(spark.createDataFrame(rows, "keyword string, ts timestamp, value double, event_id int")).collect()}
    assert got == {k: v[2] for k, v in cases.items()} | {"e": False}
    days = {"up": list(range(1, 11)), "down": list(range(10, 0, -1)), "flat": [5] * 8, "few": [1, 2]}
    rows = [(k, day.date() + dt.timedelta(days=i), float(v), float(i)) for k, vs in days.items() for i, v in enumerate(vs)]
    daily = spark.createDataFrame(rows, "group_id string, ds date, y double, x double")
    got = {r.group_id: r for r in R.predict(daily).collect()}
    assert got["up"].direction == "rising" and got["up"].predicted_peak == pytest.approx(13) and got["up"].confidence == 0.3
    assert got["down"].direction == "declining" and got["flat"].direction == "stable" and (got["few"].direction, got["few"].confidence) == ("stable", 0.0)
    f = R.forecast(daily, 7).collect()
    assert len(f) == 21 and all(r.yhat >= 0 and r.yhat_lower >= 0 for r in f) and all(abs(r.yhat - 5) < 1 for r in f if r.group_id == "flat")


def test_early_scores(spark):
    ages = [60, 70, 80, 90, 100, 110, 120, 130, 140, 150]
    rows = [(i, "g", f"s{i % 4}", AT - dt.timedelta(minutes=m)) for i, m in enumerate(ages)] + [(20 + i, "one", "s", AT) for i in range(5)] + [(30 + i, "two", f"s{i}", AT) for i in range(2)]
    got = {r.group_id: r.early_trend_score for r in S.early_score(spark.createDataFrame(rows, "article_id int, group_id string, source string, publish_time timestamp"), NOW).collect()}
    assert got["one"] == 0.0 and got["two"] <= 0.3 and 0 < got["g"] <= 1


def test_dedupe(spark):
    rows = [(1, "u1", "T", "b"), (2, "u1", "T2", "b2"), (3, "u3", "T", "b"), (4, "u4", "", ""), (5, "u5", None, None), (6, None, "Z", "z")]
    a = T.with_hashes(spark.createDataFrame(rows, "article_id int, url string, title string, body string"))
    once = C.dedupe_batch(a)
    assert sorted(r.article_id for r in once.collect()) == [1, 4, 5, 6]
    assert sorted(r.article_id for r in C.dedupe_batch(once).collect()) == [1, 4, 5, 6]
    assert sorted(r.article_id for r in C.drop_seen(a, a.filter("article_id = 1")).collect()) == [4, 5, 6]


def test_bigrams_and_graph(spark):
    a = spark.createDataFrame([(1, "machine learning machine learning machine learning deep learning"), (2, "alpha beta gamma delta epsilon zeta")], "article_id int, body string")
    got = {(r.article_id, r.bigram) for r in D.bigrams(a).collect()}
    assert (1, "machine_learning") in got and not [b for i, b in got if i == 2]
    k = [["AI", "딥러닝", "GPT", "자연어처리"], ["AI", "딥러닝", "컴퓨터비전", "로봇"], ["AI", "GPT", "챗봇", "자연어처리"]]
    g = spark.createDataFrame([("g", i, x) for i, x in enumerate(k)], "group_id string, article_id int, keywords array<string>")
    assert {r.keyword: r.frequency for r in D.keyword_nodes(g).collect()}["AI"] == 3
    e = {(r.source, r.target): r.weight for r in D.keyword_edges(g).collect()}
    assert e["GPT", "자연어처리"] == 1.0 and e["AI", "GPT"] == pytest.approx(2 / 3) and e["AI", "딥러닝"] == pytest.approx(2 / 3) and e["GPT", "딥러닝"] == pytest.approx(1 / 3)


def test_meta_trends_and_components(spark):
    rows = [("1", "A", "tech", ["AI", "채용", "IT", "기술"], 10.0), ("2", "B", "tech", ["AI", "스타트업", "투자", "기술"], 8.0), ("3", "C", "tech", ["AI", "기술", "트렌드", "미래"], 6.0), ("4", "D", "food", ["AI", "기술", "트렌드", "미래"], 9.0), ("5", "E", "tech", None, 1.0)]
    got = E.meta_trends(spark.createDataFrame(rows, "id string, title string, category string, keywords array<string>, score double"), 0.1).collect()
    assert len(got) == 1 and got[0].title == "A" and got[0].ids == ["1", "2", "3"] and got[0].score == 24.0 and len(got[0].keywords) <= 10


def test_components_of_paths_and_stars(spark):
    from tidewatch.operators.components import connected_components

    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 200 + i) for i in range(20)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for rows in (df, df.repartition(7)):
        got = {r.node: r.component for r in connected_components(rows).collect()}
        assert {got[i] for i in range(31)} == {0} and {got[200 + i] for i in range(20)} == {100} == {got[100]} and got[500] == 400
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    import random

    from tidewatch.operators.components import connected_components

    rnd = random.Random(8)
    nodes = rnd.sample(range(1000, 9000), 200)
    tree = [(nodes[i], nodes[rnd.randrange(max(0, i - 3), i)]) for i in range(1, 200)]  # deep, ids in no order
    edges = [(i, i + 1) for i in range(299)] + tree + [(10000 + i, 20000 - i) for i in range(50)] + [(20000 - i, 10001 + i) for i in range(49)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(300)} | {n: min(nodes) for n in nodes} | {n: 10000 for e in edges if e[0] >= 10000 for n in e}


def test_keyword_pairs_are_exact(spark):
    import random

    rnd = random.Random(4)
    sets = {i: set(rnd.sample("abcdefghijkl", rnd.randint(1, 7))) for i in range(70)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, keywords array<string>")
    for floor in (0.2, 0.5, 0.7, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= floor - 1e-12}
        assert {(r.a, r.b) for r in E.keyword_pairs(df, "id", floor).collect()} == want


def test_similarity_edges_need_no_shared_keyword(spark, monkeypatch):
    import math
    import random

    from tidewatch.params import Similarity

    from tidewatch.operators import metric

    for name, value in (("CELL", 6), ("CHUNK", 5), ("STRIP", 3)):  # several cells, chunks and strips
        monkeypatch.setattr(metric, name, value)
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        v = [None, [], [0.0, 0.0, 0.0]][i] if i < 3 else [rnd.gauss(0, 1) for _ in range(2 if i % 9 == 0 else 3)]
        at = None if i % 13 == 0 else AT - dt.timedelta(hours=rnd.randrange(48))
        rows.append((i, None if i % 11 == 0 else rnd.sample("abcdefghijklmnop", rnd.randint(0, 4)), at, rnd.choice(["x", "y", None, ""]), v))

    def total(a, b, p):
        (x, y), (s, t) = (set(r[1] or []) for r in (a, b)), (a[3] or "", b[3] or "")
        j = len(x & y) / len(x | y) if x and y else 0.0
        if j < p.early and (a[4] is None or b[4] is None):
            return -1
        v, w = a[4] or [], b[4] or []
        size = math.hypot(*v) * math.hypot(*w)
        c = sum(f * g for f, g in zip(v, w)) / size if len(v) == len(w) and size else 0.0
        near = math.exp(-abs((a[2] - b[2]).total_seconds()) / 86400) if a[2] and b[2] else 0.0
        return p.cosine * c + p.jaccard * j + p.time * near + p.source * (0.5 if not s or not t else float(s == t))

    df = spark.createDataFrame(rows, "item_id int, keywords array<string>, published_at timestamp, source_type string, embedding array<double>")
    for p in (Similarity(), Similarity(threshold=0.25)):
        want = {(a[0], b[0]): total(a, b, p) for a, b in itertools.combinations(rows, 2) if total(a, b, p) >= p.threshold}
        assert {(r.a, r.b): r.weight for r in E.similarity_edges(df, p).collect()} == pytest.approx(want)
    assert any(not set(rows[a][1] or []) & set(rows[b][1] or []) for a, b in want)


def test_match_groups_by_vectors_alone(spark, monkeypatch):
    import math
    import random

    from tidewatch.operators import metric

    for name, value in (("CELL", 6), ("CHUNK", 5), ("STRIP", 3)):  # several cells, chunks and strips
        monkeypatch.setattr(metric, name, value)
    rnd = random.Random(3)
    words = ["storm", "river", "comet", "grain", "opera", "engine", "harbour", "market"]
    vector = lambda i: None if i % 10 == 9 else [rnd.gauss(0, 1) for _ in range(3)]
    rows = [(i, rnd.sample(words, rnd.randint(0, 4)) if i % 8 else [], "12" if i % 8 == 0 else rnd.choice(words), vector(i)) for i in range(1, 41)]
    groups = [(f"g{i}", rnd.sample(words, rnd.randint(0, 5)), rnd.choice(words), float(i % 5), AT - dt.timedelta(hours=1), vector(i)) for i in range(30)]
    a = spark.createDataFrame(rows, "article_id int, keywords array<string>, title string, embedding array<double>")
    g = spark.createDataFrame(groups, "id string, keywords array<string>, title string, score double, created_at timestamp, embedding array<double>")
    far = 0
    for threshold in (0.3, 0.5, 0.6):
        want = {}
        for i, k, t, v in rows:
            x = set(k) | ({t} if not t.isdigit() else set())
            best = []
            for n, gk, gt, score, _, w in groups if x else []:
                y = set(gk) | {gt}
                j = len(x & y) / len(x | y)
                c = sum(p * q for p, q in zip(v, w)) / math.hypot(*v) / math.hypot(*w) if v and w else 0.0
                best.append((-round(0.5 * j + 0.5 * c, 9), -score, n, j))
            if best and -min(best)[0] >= threshold:
                want[i] = (min(best)[2], -min(best)[0])
                far += min(best)[3] < 0.1
        got = {r.article_id: (r.group_id, r.similarity) for r in E.match_groups(a, g, NOW, threshold).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
        assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert far  # such matches were lost


def test_timeline_and_feed(spark):
    a = spark.createDataFrame([(1, "g", "s1", AT - dt.timedelta(minutes=30)), (2, "g", "s2", AT), (3, "g", "s1", AT - dt.timedelta(days=3)), (4, None, "s", AT)], "article_id int, group_id string, source string, publish_time timestamp")
    got = G.timeline(a, spark.createDataFrame([("g",), ("h",)], "id string"), "15m", NOW).collect()
    assert len(got) == 2 * 25
    by = {(r.group_id, r.bucket): r.article_count for r in got if r.article_count}
    assert by == {("g", 22): 1, ("g", 24): 1}


def test_weights_brands_debounce(spark):
    stats = spark.createDataFrame([("u", "category", "tech", 50), ("u", "category", "sports", 20), ("u", "total", "events", 70)], "user_id string, kind string, name string, cnt long")
    assert {r.category: r.weight for r in H.suggested_weights(stats).collect()} == {"tech": 2.0, "sports": 1.1}
    brands = spark.createDataFrame([(1, "b", ["k"]), (2, "c", ["none"])], "id int, brand_name string, keywords array<string>")
    sns = spark.createDataFrame([(i, "k", 5.0 * v, "positive", AT) for i, v in enumerate((0.2, 0.4, 0.4, 0.4, 0.5, 0.5, 0.7, 0.9))], "id int, keyword string, burst_z double, sentiment_badge string, snapshot_at timestamp")
    got = {r.id: (r.mean, r.std) for r in H.brand_baseline(brands, sns, NOW).collect()}
    assert got[1] == pytest.approx((0.5, 0.2)) and got[2] == (0.0, 0.0)
    alerts = spark.createDataFrame([("s", i, AT + dt.timedelta(minutes=m)) for i, m in enumerate((0, 5, 15, 24, 40))], "service string, event_id int, ts timestamp")
    assert [r.notify for r in H.debounce_alerts(alerts).orderBy("event_id").collect()] == [True, False, True, False, True]


def test_html_and_sources(spark):
    page = "<html><head><style>p{}</style><script>x</script></head><body><nav>menu</nav><p>First paragraph with enough text in it.</p><p>Second one, a little longer than that.</p><footer>f</footer></body></html>"
    got = A.html_to_text(spark.createDataFrame([(page,), ("<p>short</p>",), (None,)], "html string")).collect()
    assert got[0].text == "First paragraph with enough text in it.\nSecond one, a little longer than that." and got[1].text == got[2].text == ""
    e = A.ingest_events(spark.createDataFrame([("click", 1), (None, 2)], "action string, user_id long")).collect()
    assert len(e) == 1 and e[0].meta == "{}" and e[0].item_id is None


def test_silhouette_and_refine(spark):
    rows = [(i, i // 4, [1.0, 0.05 * (i % 4)] if i < 4 else [0.05 * (i % 4), 1.0]) for i in range(8)]
    v = spark.createDataFrame(rows, "article_id int, cluster_id int, embedding array<double>")
    assert E.silhouette(v).first().silhouette > 0.9
    assert E.silhouette(v.filter("cluster_id = 0")).first().silhouette is None
    out = E.refine_clusters(v).collect()
    assert len(out) == 8 and all((r.cluster_id is None) == r.evicted for r in out)


def test_spam_model_and_grounding(spark):
    from tidewatch.functions.models import spam_model

    rows = [(f"http://x.y/{i} buy now casino prize" if i % 2 else f"a calm sentence number {i} about trees and rivers", i % 2) for i in range(60)]
    out = spam_model(spark.createDataFrame(rows, "text string, label int"), spark.createDataFrame(rows, "text string, label int").drop("label"), trees=3).collect()
    assert all((r.spam_probability > 0.5) == r.text.startswith("http") for r in out)
    g = spark.createDataFrame([(1, "a b c d", ["u1", "zz"]), (2, "q r", ["u1"])], "k int, text string, cited array<string>")
    s = spark.createDataFrame([(1, "A b x", "u1"), (1, "c", "u2")], "k int, text string, url string")
    got = {r.k: (r.recall, r.grounded, r.cited) for r in T.grounding_gate(g, s, "k").collect()}
    assert got == {1: (0.75, True, ["u1"]), 2: (0.0, False, [])}


def test_containing_by_broadcast_and_by_shuffle(spark):
    from tidewatch.functions.text import containing, infer_category
    from tidewatch.operators.feeds import search_articles

    texts = {1: "the rain in spain", 2: "", 3: None, 4: "a", 5: "ab ab", 6: "Ünïcode 日本語 text", 7: "spa"}
    words = ["rain", "a", "ab", "spa", "本語", "zz", "", None, "the rain in spain and more"]
    rows = spark.createDataFrame(list(texts.items()), "id long, t string")
    table = spark.createDataFrame([(w,) for w in words], "k string")
    want = sorted((i, w) for i, t in texts.items() for w in words if t and w and w in t)
    for limit in (1 << 20, 0):
        assert sorted((r.id, r.k) for r in containing(rows, "t", table, limit).collect()) == want
    articles = spark.createDataFrame([(i, t, None, "general") for i, t in texts.items()], "article_id long, title string, body string, category string")
    dictionary = spark.createDataFrame([("weather", "RAIN", 2.0), ("weather", "spain", 1.5), ("travel", "spa", 3.5), ("letters", "ab", 3.0)], "category string, keyword string, weight double")
    for limit in (1 << 20, 0):
        got = {r.article_id: r.category for r in infer_category(articles, dictionary, limit_bytes=limit).collect()}
        assert got == {1: "travel", 2: "general", 3: "general", 4: "general", 5: "letters", 6: "general", 7: "travel"}
    queries = spark.createDataFrame([("q", ["SPA", "rain"]), ("r", ["nothing"])], "query_id string, keywords array<string>")
    found = search_articles(articles.selectExpr("article_id", "title", "timestamp'2024-01-01' publish_time"), queries)
    assert [(r.query_id, r.article_id) for r in found.orderBy("rank").collect()] == [("q", 1), ("q", 7)]


def test_stream_dedupe_forgets_after_its_memory(spark, tmp_path):
    """A key is let through again once the watermark, seven days behind the newest row of the batches before, has passed
    its seven days: ``a`` and ``b`` are, ``c`` of day 18 is not yet."""
    from tidewatch.streaming.streams import stream_dedupe

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "key string, ts timestamp, n int"
    files = [[("a", day(0), 1), ("b", day(0), 2)], [("a", day(5), 3), ("c", day(6), 4)], [("x", day(16), 5)], [("a", day(17), 6), ("c", day(18), 7)], [("b", day(40), 8)]]
    query = None
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_dedupe(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", "ts")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 5, 6, 8]


def test_vectors_and_words_in_one_similarity(spark):
    """Blocks of several sizes, items without vectors, words or times: all pairs by brute force."""
    import numpy as np

    from tidewatch.operators import clusters as E
    from tidewatch.params import Similarity

    rnd = np.random.default_rng(6)
    rows = []
    for i in range(60):
        vector = None if i % 6 == 0 else rnd.normal(size=4 if i % 7 else 5).tolist()
        words = None if i % 11 == 0 else [f"w{k}" for k in rnd.choice(12, rnd.integers(0, 5), replace=False)]
        rows.append((i, words, None if i % 13 == 0 else 1_700_000_000 + int(rnd.integers(0, 200_000)), None if i % 5 == 0 else f"s{i % 3}", vector))
    df = spark.createDataFrame(rows, "item_id long, keywords array<string>, published_at long, source_type string, embedding array<double>")
    df = df.selectExpr("item_id", "keywords", "timestamp_seconds(published_at) published_at", "source_type", "embedding")
    p = Similarity(threshold=0.45)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] >= b[0]:
                continue
            x, y = set(a[1] or ()), set(b[1] or ())
            j = len(x & y) / len(x | y) if x and y else 0.0
            if (a[4] is None or b[4] is None) and j < p.early:
                continue
            c = float(np.dot(a[4], b[4]) / np.linalg.norm(a[4]) / np.linalg.norm(b[4])) if a[4] and b[4] and len(a[4]) == len(b[4]) else 0.0
            t = math.exp(-abs(a[2] - b[2]) / 86400) if a[2] and b[2] else 0.0
            s = 0.5 if not a[3] or not b[3] else float(a[3] == b[3])
            total = p.cosine * c + p.jaccard * j + p.time * t + p.source * s
            if total >= p.threshold:
                want[a[0], b[0]] = total
    got = {(r.a, r.b): r.weight for r in E.similarity_edges(df, p).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 20
