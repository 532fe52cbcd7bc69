"""All judged URLs are counted for the scores, those held out for the threshold too."""

import zlib

from cedarflow.llm import urlfilter as uf


def test_held_out_urls_count_in_the_end(spark):
    held = lambda u: zlib.crc32(u.encode()) % 5 == 0
    urls = [u for i in range(60) if held(u := f"http://h{i}.org/qqqq")] + [u for i in range(60) if not held(u := f"http://h{i}.org/aaaa")]
    urls += [f"http://example.org/es/w{i}" for i in range(60)]
    urls += ["http://x.net/qqqq", "http://x.net/vvvv"]  # q is in held-out URLs only, v in none
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    score = {r["path"]: r["score"] for r in uf.judge_urls(df).filter("host = 'x.net'").collect()}
    assert score["/qqqq"] < score["/vvvv"]
