"""Operators on made rows, against plain computations."""

import json
import random
import re

import psutil
import pytest
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import arrays, keys, rates, stem, text
from tidewell.operators import automaton, claims, contexts, ingest, matching, posts, reports, schedule
from tidewell.sources import files, tables
from tidewell.sources.storage import Store
from tidewell.streaming import incremental

WORDS = ["flu", "Flu shot", "tea", "été", "x.", "Ok!", "no?", "\n", "zebra", "a"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_running_sums_and_spans(spark):
    rng = random.Random(1)
    lists = [[], [5], *([rng.randint(0, 9) for _ in range(n)] for n in (63, 64, 65, 129, 5000))]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, v array<int>")
    got = {r["k"]: r["s"] for r in rows.select("k", arrays.running_sums(F.col("v")).alias("s")).collect()}
    assert all(got[k] == [sum(v[: i + 1]) for i in range(len(v))] for k, v in enumerate(lists) if len(v) < 200)
    assert got[6][-1] == sum(lists[6]) and len(got[6]) == 5000
    cases = [("aXaxA", "x"), ("", "x"), ("aaaa", "aa"), (None, "x"), ("b", ""), (r"q\Eq", r"\E"), ("é" * 300, "É")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, w string")
    got = {r["k"]: r["s"] and [tuple(x) for x in r["s"]] for r in rows.select("k", text.spans(F.col("t"), F.col("w")).alias("s")).collect()}
    for k, (t, w) in enumerate(cases):
        assert got[k] == (None if t is None else [] if not w else [m.span() for m in re.finditer(re.escape(w), t, re.I)]) or not got[k] and not w


def test_terms_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    bodies = [prose(rng, 60) for _ in range(40)] + [None, "", "é"]
    names = ["flu", "shot te", "été", "a", "x. ok", "zebra a zebra", "nothing here", "", "no? x", "FLU", None]
    p = spark.createDataFrame(list(enumerate(bodies)), "post_id int, text string")
    t = spark.createDataFrame(list(enumerate(names)), "term_id int, name string")
    want = sorted((k, j, m.start(), m.end()) for k, b in enumerate(bodies) for j, n in enumerate(names) if n for m in re.finditer(re.escape(n), b or "", re.I))
    for limit in (500_000, 12):
        monkeypatch.setattr(automaton, "PART_CHARS", limit)
        assert sorted(map(tuple, matching.span_hits(p, t).collect())) == want
        for stemmed in (False, True):
            got = {(r[0], r[1]) for r in matching.candidates(p, t, stemmed).collect()}
            have = lambda s: {stem.stem(x) if stemmed else x for x in re.findall(r"[^\W_]+", (s or "").lower()) if x not in ("a", "no", "here")}
            assert got == {(k, j) for k, b in enumerate(bodies) for j, n in enumerate(names) if have(n) and have(n) <= have(b)}


def test_super_terms_meet_on_their_rarest_word(spark):
    names = [(f"common w{k}",) for k in range(50)] + [("common",), ("w3",), ("w7 common deep",)]
    got = {r[0] for r in matching.super_terms(spark.createDataFrame(names, "name string")).collect()}
    assert got == {f"common w{k}" for k in range(50)} | {"w7 common deep"}


def sentences(t):
    return [m.span() for m in re.finditer("[^\\s][^\\n]*?(?:[.!?…]+[\"'”’)\\]]*(?=\\s|$)|(?=\\n|$))", t)]


def plain_anchor(spans, a, b):
    over = [i for i, (s, e) in enumerate(spans) if s < b and a < e]
    return over[0] if over else min(range(len(spans)), key=lambda i: (a - spans[i][1] if spans[i][1] <= a else spans[i][0] - b, i))


def merged(ranges, gap):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def split(s, e, size, step, inclusive):
    n, out = e - s + inclusive, []
    for k in range(max(1, -(-(n - size) // step) + 1)):
        out.append((s + k * step, min(e, s + k * step + size - inclusive)))
    return out


def test_contexts_equal_plain_ones(spark):
    rng = random.Random(3)
    bodies = [prose(rng, n) for n in (5, 30, 200, 900, 2500)] + ["flu " * 2000, "  flu", "tea\n\n flu"]
    p = spark.createDataFrame(list(enumerate(bodies)), "post_id int, text string")
    t = spark.createDataFrame([(1, "flu"), (2, "été")], "term_id int, name string")
    found = matching.posts_with_hits(p, matching.span_hits(p, t), t)
    got, structs = {}, {}
    for r in contexts.chunks(found).collect():
        got.setdefault(r["post_id"], {})[r["chunk_index"]] = r["chunk"]
    for r in contexts.contexts(found).collect():
        structs.setdefault(r["post_id"], []).append((r["start_sentence_idx"], r["end_sentence_idx"], r["text"], r["term_ids"], len(r["hit_spans"])))
    for k, body in enumerate(bodies):
        hits = [(m.start(), m.end(), j) for j, n in ((1, "flu"), (2, "été")) for m in re.finditer(n, body, re.I)]
        spans = sentences(body)
        if not hits:
            assert k not in got
            continue
        if len(spans) > 1:
            at = [plain_anchor(spans, a, b) for a, b, _ in hits]
            parts = [x for s, e in merged([(max(0, i - 4), min(len(spans) - 1, i + 4)) for i in at], 1) for x in split(s, e, 16, 12, True)]
            ranges = [(spans[s][0], spans[e][1]) for s, e in parts]
            want = [(s, e, body[a:b].strip(" "), sorted({h[2] for h, i in zip(hits, at) if s <= i <= e}), sum(s <= i <= e for i in at)) for (s, e), (a, b) in zip(parts, ranges)]
        else:
            ranges = [x for s, e in merged([(max(0, a - 1000), min(len(body), b + 1000)) for a, b, _ in hits], 0) for x in split(s, e, 11200, 10000, False)]
            inside = lambda a, b: [h for h in hits if h[1] > a and h[0] < b]
            want = [(0, 0, body[a:b].strip(" "), sorted({h[2] for h in inside(a, b)}), len(inside(a, b))) for a, b in ranges]
        pieces = sorted(x for a, b in ranges for x in split(a, b, 12000, 11600, False))
        assert got[k] == {i: c for i, (a, b) in enumerate(pieces) if (c := body[a:b].strip(" "))}
        assert sorted(structs[k]) == sorted(want)


def test_relocated_hits(spark):
    rows = [("I like tea a lot", "Ann likes TEA a lot", 7, 10, "tea"), ("see it", "see the flu shot", 4, 6, "flu"), ("abcdef", "xy", 3, 5, "q"), ("a", "", 0, 1, "z"), ("far " * 200 + "tea", "tea " + "z" * 900, 800, 803, "tea")]
    got = [tuple(r["place"]) for r in contexts.relocated(spark.createDataFrame(rows, "original string, rewritten string, match_start int, match_end int, term_name string").coalesce(1)).collect()]
    assert got == [(10, 13), (8, 11), (1, 2), (0, 0), (0, 3)]


def test_coreference_keeps_texts_that_fail(spark):
    def rewrite(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.replace("he", "Bob") for t in texts]

    rows = spark.createDataFrame([(1, "he ran"), (2, "bad he"), (3, None)], "k int, text string").coalesce(1)
    got = {r["k"]: r["text_coreference_resolved"] for r in contexts.resolve(rows, rewrite).collect()}
    assert got == {1: "Bob ran", 2: "bad he", 3: ""}
    with pytest.raises(Exception, match="longer"):
        contexts.resolve(spark.createDataFrame([("x" * 13000,)], "text string"), rewrite).collect()


def test_rounding_of_doubles(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, n), n) for n in (rng.choice([3, 7, 8, 16, 200, 400, 800, 1000, 8000, 99991]) for _ in range(4000))] + [(1, 800), (3, 800), (0, 5), (5, 5)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    for r in rows.select("a", "b", reports.coverage(F.col("a"), F.col("b")).alias("p")).collect():
        assert r["p"] == round(r["a"] / r["b"] * 100.0, 2)
    assert spark.createDataFrame([(0, 0)], "a long, b long").select(reports.coverage(F.col("a"), F.col("b"))).first()[0] is None


def test_rates_fold_without_arrays(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0.0, rng.random() * 5])) for k in range(6) for i in range(rng.randint(1, 80))] + [(9, 0, 0.0), (9, 1, 0.0)]
    want = {}
    for k, _, x in rows:
        want[k] = x if want.get(k, 0.0) == 0.0 else 0.3 * x + 0.7 * want[k]
    got = {r["k"]: r["rate"] for r in rates.latest_ewma(spark.createDataFrame(rows, "k int, i int, x double"), "k", "i", "x").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)], "k int, v string").repartition(7)
    assert sorted((r["n"], r["k"]) for r in session.numbered(rows, ["k"], "n", 40).collect()) == [(k + 41, k) for k in range(1000)]
    assert session.numbered(rows.limit(0), ["k"], "n").count() == 0
    empty = spark.createDataFrame([], "id long, platform string, key1 string, key2 string, post_key string")
    first = posts.register(empty, spark.createDataFrame([("tweet", "b", ""), ("tweet", "a", ""), ("tweet", "a", ""), ("tweet", None, "")], "platform string, key1 string, key2 string"))
    assert [(r["id"], r["post_key"]) for r in first.orderBy("id").collect()] == [(1, "tweet:a"), (2, "tweet:b")]
    more = posts.register(first, spark.createDataFrame([("tweet", "b", ""), ("tweet", "0", "")], "platform string, key1 string, key2 string"))
    assert [(r["id"], r["key1"]) for r in more.collect()] == [(3, "0")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Fake:
        class sparkContext:
            master, applicationId = "yarn", "a"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch(Fake, "x")


def test_workers_give_freed_memory_back():
    used = lambda: psutil.Process().memory_info().rss

    def run(batches):
        held = [b"x" * 100_000 for _ in range(2000)]
        pins.append(held[-1])  # keeps the C library from giving back what lies before
        yield from batches

    pins = []
    plain, end = used(), object()
    task = session.released(run)(iter([1, 2]))
    assert [next(task), next(task)] == [1, 2] and used() > plain + 150_000_000
    assert next(task, end) is end and used() < plain + 50_000_000


def test_trees_name_what_waits(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(6)] + [(50, 51), (51, 50), (60, 99)], "id int, parent int")
    loaded, waiting = ingest.load_tree(chain, "id", "parent", passes=4)
    assert sorted(map(tuple, loaded.select("id", "pass").collect())) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert sorted(r["id"] for r in waiting.collect()) == [4, 5, 50, 51, 60]
    rest, _ = ingest.load_tree(waiting, "id", "parent", present=loaded.select("id"))
    assert sorted(r["id"] for r in rest.collect()) == [4, 5]


def test_deep_trees_circles_and_orphans(spark):
    n = 10_000
    rows = [(k, k - 1 if k else None) for k in range(n)]
    rows += [(n + k, n + (k + 1) % 7) for k in range(7)] + [(n + 20, n + 3), (n + 21, n + 20), (n + 30, n + 30)]  # circles, and what hangs on one
    rows += [(n + 40, -1), (n + 41, n + 40), (None, 1), (n + 50, 5), (n + 50, 6)]
    loaded, waiting = ingest.load_tree(spark.createDataFrame(rows, "id int, parent int").repartition(5), "id", "parent")
    got = {(r["id"], r["pass"]) for r in loaded.collect()}
    assert got == {(k, k + 1) for k in range(n)} | {(n + 50, 7)} and loaded.count() == n + 2
    reasons = {r["id"]: (r["reason"], r["circle"]) for r in waiting.collect()}
    assert reasons == {**{n + k: ("circle", n) for k in (*range(7), 20, 21)}, n + 30: ("circle", n + 30), n + 40: ("orphan", None), n + 41: ("orphan", None), None: ("no id", None)}
    empty, none = ingest.load_tree(spark.createDataFrame([], "id int, parent int"), "id", "parent")
    assert empty.count() == none.count() == 0


def test_trees_send_no_nodes_along(spark, monkeypatch):
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ingest, "materialise", lambda df, name: plans.append(plan(df)) or session.materialise(df, name))
    nodes = spark.range(200).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("parent"))
    loaded, waiting = ingest.load_tree(nodes, "id", "parent")
    plans += [plan(loaded), plan(waiting)]
    assert len(plans) > 5 and "SortMergeJoin" in plans[-1] and not any("BroadcastExchange" in p for p in plans)
    assert loaded.count() == 200 and waiting.count() == 0


def test_rejected_rows_are_found_by_halves(spark):
    def insert(batch):
        if any(v is not None and v % 17 == 0 for v in batch.column(0).to_pylist()):
            raise ValueError("constraint")

    rows = spark.range(100).select(F.col("id").alias("v"), F.lit("s").alias("s"))
    got = ingest.rejected(rows, insert)
    assert got.columns == ["v", "s", "error"] and sorted((r["v"], r["error"]) for r in got.collect()) == [(k, "ValueError: constraint") for k in range(0, 100, 17)]
    assert ingest.rejected(rows.limit(0), insert).count() == 0


def test_budget_slots_and_waits(spark):
    rows = spark.createDataFrame([("d", k, u) for k, u in enumerate([100, 150, 80, 30, 15, None, 5])] + [("e", 0, 300), ("e", 1, 200)], "day string, seq int, units int")
    got = sorted((r["day"], r["seq"], r["accepted"], r["used"]) for r in schedule.charge(rows, 200).collect())
    assert got == [("d", 0, True, 100), ("d", 1, False, 100), ("d", 2, True, 180), ("d", 3, False, 180), ("d", 4, True, 195), ("d", 5, False, 195), ("d", 6, True, 200), ("e", 0, False, 0), ("e", 1, True, 200)]
    assert schedule.charge(rows.limit(0), 5).count() == 0
    rng = random.Random(3)
    many = [(rng.choice("xyz") if k % 50 else None, k, rng.choice([None, -1, 0, 1, 2, 3, 7, 40])) for k in range(3000)]
    used, want = {}, []
    for d, k, u in many:
        ok = u is not None and u >= 0 and used.get(d, 0) + u <= 300
        used[d] = used.get(d, 0) + (u if ok else 0)
        want.append((k, ok, used[d]))
    parts = spark.createDataFrame(many, "day string, seq int, units int").repartition(4)
    assert sorted((r["seq"], r["accepted"], r["used"]) for r in schedule.charge(parts, 300).collect()) == want
    r = spark.range(1).select(schedule.slots(F.lit(100.0), F.lit(100.0), 4, 0.9).alias("s")).first()
    assert r["s"] == [111.25, 133.75, 156.25, 178.75]
    w = lambda a, s, d: spark.range(1).select(schedule.backoff_seconds(F.lit(a), F.lit(s).cast("int"), F.lit(d))).first()[0]
    assert [w(0, None, 0.5), w(3, None, 0.5), w(40, None, 0.0), w(1, 0, 0.5), w(1, 900, 1.0)] == pytest.approx([2, 16, 240, 1, 360])


def test_windows_of_a_backward_crawl():
    from datetime import datetime, timedelta

    b = schedule.Backfill(datetime(2024, 6, 1))
    half = b.after(True)
    assert half.end == b.end and half.days == 15
    wide = half.after(False)
    assert wide.end == half.window[0] + timedelta(minutes=5) and wide.days == 30
    low = schedule.Backfill(datetime(2024, 6, 1), 8.0).after(True)
    assert low.days == 7 and low.after(True).end == low.window[0] + timedelta(minutes=5)
    assert schedule.Backfill(datetime(2024, 6, 1), 80.0).after(False).days == 90


def test_stale_entries_are_skipped(spark):
    q = spark.sql("select * from values (1, timestamp'2024-01-01'), (1, timestamp'2024-01-03'), (2, timestamp'2024-01-02'), (2, timestamp'2024-01-02'), (3, timestamp'2024-02-01') t(term_id, next_run_at)")
    state = spark.sql("select * from values (1, timestamp'2024-01-03'), (2, timestamp'2024-01-02'), (3, timestamp'2024-02-01') t(term_id, next_run_at)")
    assert [r["term_id"] for r in schedule.due_runs(q, state, "2024-01-05").collect()] == [2, 1]


def test_error_kinds(spark):
    cases = [(403, "quotaExceeded", "quota"), (403, "userRateLimitExceeded", "retryable"), (403, "forbidden", "fatal"), (403, None, "fatal"), (None, None, "retryable"), (500, None, "retryable"), (501, None, "fatal"), (404, "notFound", "fatal"), (400, "dailyLimitExceededUnreg", "quota")]
    rows = spark.createDataFrame([(k, s, r) for k, (s, r, _) in enumerate(cases)], "k int, s int, r string")
    assert {r["k"]: r["e"] for r in rows.select("k", schedule.error_kind(F.col("s"), F.col("r")).alias("e")).collect()} == {k: e for k, (*_, e) in enumerate(cases)}


def test_labels_after_and_below_the_cursor(spark):
    p = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", True), (4, "a", None), (5, "a", None)], "post_id int, platform string, is_en boolean")
    new, cursor = incremental.label_new(p, 3, lambda d: d)
    assert ({r["post_id"] for r in new.collect()}, cursor) == ({4, 5}, 5)
    assert {r["post_id"] for r in incremental.recheck(p, 4, lambda d: d).collect()} == {1, 2}
    assert {r["post_id"] for r in incremental.recheck(p, 4, lambda d: d, "b").collect()} == {2}
    assert incremental.label_new(p.limit(0), 7, lambda d: d)[1] == 7


def test_fetch_states_keep_validators(spark):
    states = spark.sql("select 1 as id, 'e' as etag, 'm' as last_modified, timestamp'2024-01-01' as last_fetch_ts, 200 as last_http_status, 'old' as last_error union all select 2, 'k', null, null, null, null")
    answers = spark.sql("select 1 as id, null as etag, '' as last_modified, 304 as http_status, cast(null as string) as error, timestamp'2024-01-03' as at union all select 1, 'x', 'x', 500, repeat('y', 3000), timestamp'2024-01-02'")
    got = {r["id"]: tuple(r)[1:] for r in ingest.fetch_states(states, answers).collect()}
    assert got[1][:2] == ("e", "m") and got[1][3:] == (304, None) and got[2] == ("k", None, None, None, None)


def test_store_writes_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put("a/b.bin", bytes(range(256)))
    store.put("a/b.bin", (b"x", b"y" * 10))
    assert store.get("a/b.bin") == b"x" + b"y" * 10 and store.names() == ["a/b.bin"] and store.exists("a/b.bin")

    def broken():
        yield b"half"
        raise KeyError("stop")

    with pytest.raises(KeyError):
        store.put("a/b.bin", broken())
    assert store.get("a/b.bin").startswith(b"xy") and store.names() == ["a/b.bin"]
    assert store.delete("a/b.bin") and not store.exists("a/b.bin")
    with pytest.raises(FileNotFoundError):
        store.get("a/b.bin")
    with pytest.raises(ValueError):
        store.put("../x", b"")


def test_documents_round_trip_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"té \"{k}\"\n", [k, k + 1], None) for k in range(50)], "post_id int, text string, hits array<int>, url string")
    n = files.write_json_document(rows, str(tmp_path), "out.json", {"generated_at_utc": "2024", "terms": ["é"]}, order=["post_id"])
    doc = json.loads((tmp_path / "out.json").read_text())
    assert (n, doc["post_count"], doc["terms"], len(doc["posts"]), doc["posts"][3]["url"]) == (50, 50, ["é"], 50, None)
    back = files.read_posts_json(spark, str(tmp_path / "out.json"))
    assert sorted((r["post_id"], r["text"], r["hits"]) for r in back.collect()) == sorted((r["post_id"], r["text"], r["hits"]) for r in rows.collect())
    assert files.write_json_document(rows.limit(0), str(tmp_path), "none.json") == 0 and json.loads((tmp_path / "none.json").read_text())["posts"] == []
    out = str(tmp_path / "lines")
    tasks = rows.select(F.col("post_id").cast("string").alias("task_id"), "text")
    assert [files.append_new(tasks.filter("post_id < 20"), out), files.append_new(tasks, out), files.append_new(tasks, out)] == [20, 30, 0]
    assert spark.read.json(out).select("task_id").distinct().count() == 50


def test_reports_are_lines(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1, None), (2, "b")], "a int, b string").coalesce(1), ["a", "b"], str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    assert part.read_text() == "1\t\n2\tb\n"


def test_search_pages_end_and_ids_go_in_chunks(spark):
    page = lambda ids, more: json.dumps({"items": [{"id": {"videoId": i}} for i in ids], **({"nextPageToken": "t"} if more else {})})
    rows = spark.createDataFrame([("q", 0, page(["a", "b"], True)), ("q", 1, page(["c", "a"], False)), ("q", 2, page(["never"], True)), ("r", 0, page([], True)), ("r", 1, page(["no"], True))], "term string, page int, payload string")
    got = files.search_pages(rows, by=["term"])
    assert sorted((r["term"], r["page"], r["position"], r["video_id"], r["last"]) for r in got.collect()) == [("q", 0, 0, "a", False), ("q", 0, 1, "b", False), ("q", 1, 0, "c", True), ("q", 1, 1, "a", True)]
    assert [tuple(r) for r in files.request_chunks(got, ["term"], ["page", "position"], size=2).orderBy("chunk").collect()] == [("q", 0, "a,b"), ("q", 1, "c")]
    reply = {"items": [{"id": "r1", "snippet": {"parentId": "c", "textDisplay": "d", "publishedAt": "2024-01-01T00:00:00Z"}}]}
    r = files.api_replies(spark.createDataFrame([("v", json.dumps(reply))], "video_id string, payload string")).first()
    assert (r["comment_id"], r["parent_comment_id"], r["text"], r["like_count"]) == ("r1", "c", "d", 0)
    msgs = spark.sql("select timestamp'2024-01-02' as created_at_ts, 'x' as text union all select timestamp'2024-01-01', 'y' union all select timestamp'2023-12-31', 'z' union all select timestamp'2024-02-01', ' '")
    assert {r["text"] for r in files.since(msgs, "2024-01-01").collect()} == {"x", "y"}


def test_claims_are_tried_again_and_checked(spark):
    good = json.dumps({"claims": [{"claim": "c", "claim_stance_to_vaccines": "pro", "author_stance_to_claim": "support", "attribution": "self"}]})

    class RateLimitError(Exception):
        pass

    seen: dict = {}

    def call(t):
        seen[t] = seen.get(t, 0) + 1
        if t == "limit" and seen[t] < 3:
            raise RateLimitError("slow down")
        if t == "never":
            raise TimeoutError("gone")
        if t == "terminal":
            raise RuntimeError("Content Policy violation")
        if t == "malformed":
            return "[]"
        if t == "second":
            return "oops" if seen[t] == 1 else good
        return good.replace('"pro"', '"maybe"') if t == "stance" else f"```json\n{good}\n```"

    waits: list = []
    assert claims.attempt(call, "limit", 4, waits.append) and waits == [0.75, 1.5]
    assert claims.attempt(call, "second", 4, waits.append) == good
    seen.clear()
    texts = ["limit", "never", "terminal", "malformed", "second", "stance", "fine"]
    rows = spark.createDataFrame([(t,) for t in texts], "input_text string").coalesce(1)
    got = {r["input_text"]: r for r in claims.extract(rows, call, wait=lambda s: None).collect()}
    assert {t: got[t]["claim_extraction_disposition"] for t in texts} == {"limit": "success", "never": "retryable_failure", "terminal": "terminal_failure", "malformed": "retryable_failure", "second": "success", "stance": "terminal_failure", "fine": "success"}
    assert got["stance"]["claim_extraction_error"] == "ValueError: invalid claim_stance_to_vaccines" and len(got["fine"]["claim_extraction_output"]["claims"]) == 1


def test_audio_files_inside_links(spark):
    cases = {
        "https://a.example.com/e/b.example.org/x%20y/c.mp3?u=1": ["https://a.example.com/e/b.example.org/x"],
        "https://t.co/r/play.pod.fm/s/cdn.io/f/ep.m4a?x=/z.MP3": ["https://cdn.io/f/ep.m4a", "https://play.pod.fm/s/cdn.io/f/ep.m4a", "https://t.co/r/play.pod.fm/s/cdn.io/f/ep.m4a"],
        "https://x.com/none.txt": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r["u"]: r["c"] for r in rows.select("u", keys.audio_candidates(F.col("u")).alias("c")).collect()}
    assert got["https://x.com/none.txt"] == [] and got["https://t.co/r/play.pod.fm/s/cdn.io/f/ep.m4a?x=/z.MP3"] == cases["https://t.co/r/play.pod.fm/s/cdn.io/f/ep.m4a?x=/z.MP3"]


def test_live_filter_and_catalog(spark):
    t = spark.createDataFrame([("Flu",), ("flu shot",), (None,), ("tea",)], "name string")
    assert {r[0] for r in matching.live_filter(t, " FLU|te. ").collect()} == {"Flu", "flu shot", "tea"} and matching.live_filter(t, " ").count() == 4
    rows = tables.columns(spark, "/root/testdata/sf0.001", ["nation"]).collect()
    assert [r["column_name"] for r in rows] == ["n_nationkey", "n_name", "n_regionkey"]
    assert tables.row_counts(spark, "/root/testdata/sf0.001", ["nation", "region"]).count() == 2


def test_stems_of_known_words():
    from tidewell.functions.stem import stem

    pairs = "consign consign consigned consign consigning consign consistency consist knackeries knackeri knitted knit generously generous vaccination vaccin vaccines vaccin relational relat hopping hop dying die agreed agre owed owe skies sky cries cri".split()
    assert {a: stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))
