import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import matching
from tidewell.sources import files
from tidewell.streaming import incremental


def test_json_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text(json.dumps({"channel_id": 1, "message_id": 2, "date": "2024-01-02T03:04:05Z", "text": "hi"}) + "\n\n" + json.dumps({"channel_id": 1, "message_id": 3, "text": " "}) + "\n")
    rows = files.telegram_posts(spark, str(p)).collect()
    assert [(r["message_id"], str(r["created_at_ts"])) for r in rows] == [(2, "2024-01-02 03:04:05")]


def test_csv_rates_terms(spark, tmp_path):
    (tmp_path / "r.csv").write_text("term,scrapes_per_day\n# no\ncovid,4.0\nbad,x\n")
    assert [tuple(r) for r in files.read_rates(spark, str(tmp_path / "r.csv")).collect()] == [("covid", 4.0)]
    (tmp_path / "t.txt").write_text("# c\nb\na\nb\n")
    assert files.read_terms(spark, str(tmp_path / "t.txt"), ["a"]) == ["a", "b"]
    (tmp_path / "c.csv").write_text("id,parent_id,link_id,body,permalink,created_utc,subreddit_id,subreddit_type,total_awards_received,subreddit,score,gilded,stickied,is_submitter,gildings,all_awardings,is_en\n1,t3_a,t3_a,\"x\ny\",p,1700000000.0,s,public,0,v,5,0,True,no,\"{}\",\"[]\",\n")
    r = files.comments(spark, str(tmp_path / "c.csv")).first()
    assert (r["body"], r["score"], r["stickied"], r["is_submitter"], r["is_en"], r["gildings"]) == ("x\ny", 5, True, False, None, "{}")


def test_posts_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"posts": [{"post_id": 1}, {"post_id": 2}]}, indent=2))
    assert files.read_posts_json(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "e.json").write_text("{\"x\": 1}")
    with pytest.raises(ValueError):
        files.read_posts_json(spark, str(tmp_path / "e.json"))


def test_api_payloads(spark):
    video = {"items": [{"id": "v", "snippet": {"title": "t", "publishedAt": "2024-01-01T00:00:00Z"}, "statistics": {"viewCount": "7"}, "contentDetails": {"duration": "PT1M"}}]}
    r = files.api_videos(spark.createDataFrame([(json.dumps(video),)], "payload string")).first()
    assert (r["view_count"], r["like_count"], r["duration_seconds"], r["url"]) == (7, 0, 60, "https://www.youtube.com/watch?v=v")
    thread = {"items": [{"snippet": {"totalReplyCount": 2, "topLevelComment": {"id": "c", "snippet": {"publishedAt": "2024-01-01T00:00:00Z", "textDisplay": "d", "likeCount": 1}}}}]}
    r = files.api_threads(spark.createDataFrame([("v", json.dumps(thread))], "video_id string, payload string")).first()
    assert (r["comment_id"], r["text"], r["reply_count"]) == ("c", "d", 2)


def test_stream_matches_each_file_once(spark, tmp_path):
    terms = spark.createDataFrame([(1, "ab")], "term_id int, name string")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "post_id long, text string"
    for k, body in enumerate(("ab ab", "xAB")):
        spark.createDataFrame([(k, body)], schema).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            incremental.match_stream(spark, source, schema, terms, out, mark).awaitTermination(60)
    got = spark.read.parquet(out).select("post_id", "match_start").orderBy("post_id", "match_start").collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 3), (1, 1)]


def test_first_seen_and_rates(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01' as ts, 1 as k, 10.0D as n, 5.0D as s union all select timestamp'2024-01-01', 1, 20.0D, 5.0D").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, k int, n double, s double").parquet(source)
    q = incremental.first_seen(stream, ["k"], "ts").writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("first_seen").count() == 1
    q = incremental.rate_stream(stream, "k", "n", "s", "n").writeStream.outputMode("update").format("memory").queryName("rate_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rate_stream").agg(F.max("rate")).first()[0] == pytest.approx(2.6)


def test_effective_terms(spark):
    terms = spark.createDataFrame([("Flu",), ("flu shot",), ("shot",), ("pfizer's jab",)], "name string")
    assert {r[0] for r in matching.effective_terms(terms).collect()} == {"Flu", "shot", "pfizer's jab"}
