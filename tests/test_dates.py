"""Relative dates against a loop over their phrases."""

import datetime as dt
import re

from pyspark.sql import functions as F

from keepsake.operators import consolidate
from keepsake.plans import queries as Q

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
PHRASES = re.compile(rf"\b(yesterday|today|tomorrow|(?:last|next) (?:{'|'.join(DAYS)}|week|month)|(\d+) days? ago|this (?:morning|afternoon|evening|week|month))\b", re.IGNORECASE | re.ASCII)


def brute(text, day):
    if text is None or day is None:
        return text

    def said(m):
        low = m[0].lower()
        step = {"last": -1, "this": 0, "next": 1}.get(low.split()[0])
        rest = low.split()[-1]
        on = lambda d: f"on {d:%Y-%m-%d}"
        if m[2]:
            return on(day - dt.timedelta(int(m[2]))) if int(m[2]) < day.toordinal() else m[0]
        if rest == "week":
            return f"the week of {day + dt.timedelta(7 * step):%Y-%m-%d}"
        if rest == "month":
            year, month = divmod(day.year * 12 + day.month - 1 + step, 12)
            return f"{dt.date(year, month + 1, 1):%B %Y}"
        if rest in DAYS:
            d = day + dt.timedelta(step)
            while d.weekday() != DAYS.index(rest):
                d += dt.timedelta(step)
            return on(d)
        return on(day + dt.timedelta({"yesterday": -1, "tomorrow": 1}.get(low, 0)))

    return PHRASES.sub(said, text).replace("on on ", "on ")


def test_every_phrase(spark):
    phrases = ["yesterday", "Today", "TOMORROW", "this morning", "this evening", "1 day ago", "3 days ago", "400 Days Ago", "99999999999 days ago", "900000 days ago"]
    phrases += [f"{w} {x}" for w in ("last", "next") for x in (*DAYS, "week", "Month")] + ["this week", "this month"]
    texts = [f"met {p}, then on {p} again" for p in phrases] + [" and ".join(phrases), "yesterday days ago", "x3 days ago", "todays last weeks", "é yesterday", "on on x", "", None, "plain"]
    anchors = [dt.date(2024, 3, 31), dt.date(2024, 1, 1), dt.date(2023, 12, 31), dt.date(2024, 2, 29), None]
    rows = [(t, a) for t in texts for a in anchors]
    df = spark.createDataFrame(rows, "t string, a date").withColumn("got", consolidate.absolute_dates(F.col("t"), F.col("a").cast("timestamp")))
    for r in df.collect():
        assert r["got"] == brute(r["t"], r["a"]), (r["t"], r["a"])


def test_content_is_read(spark, tmp_path):
    docs = [(1, "we met last Friday"), (2, "nothing here"), (3, "shipped 3 days ago")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    day = lambda i: dt.date(2024, 1, 30) - dt.timedelta(7 * i)
    got = {r["id"]: r["content"] for r in Q.QUERIES["absolutize_content"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t, day(i)) for i, t in docs} and got[1] != docs[0][1]
