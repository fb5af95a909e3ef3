import re

from keepsake.llm.licenses import NOT_WORD, PHRASES, TEMPLATES, op1_licenses, scan_licenses, template_tokens


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    starts, base, found, best = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    for line in (text or "").split("\n"):
        block = set(re.sub(NOT_WORD, " ", ascii_lower(line)).split(" ")) - {""}
        for label, t in TEMPLATES:
            own = template_tokens(t)
            c = len(block & set(own)) / len(own)
            if c >= 0.8 - 1e-9:
                found.add(label)
                best = max(best, c)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), round(1.0 if starts else best, 9))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")


def test_equals_brute_force(spark):
    gpl = TEMPLATES[8][1]
    texts = [
        None, "", "a", "under the MIT license", "Under  the\nMIT--License! x under the mit license", "apache license, version 2.0 Apache License Version 2",
        "xunder the mit license", "under the mit licenses", "CC BY-NC cc by nc cc\tby\tnc", "é under the mit license ß", gpl, gpl.replace("work ", "").upper(), "line\n" + gpl + "\nmore",
        "this work is licensed under general public", " ".join(TEMPLATES[1][1].split()[3:]), "word " * 30000 + "\n" + TEMPLATES[6][1], "All rights reserved. No part of this work may be copied",
        "license", "the under mit license", "under the mit licenseé", "under the mit license", "\n\n\n", TEMPLATES[13][1] + TEMPLATES[14][1],
    ]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[10], None), (3, texts[11], "c"), (3, texts[11], "c")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS), round(r["score"], 9)) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _ in rows), key=key)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_licenses(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (*(r[c] for c in COLUMNS), round(r["score"], 9)) == brute(docs[r["doc_id"]])


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def labels(spark, *texts):
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r["labels"] for r in rows]


def wrapped(text, n, mark="# "):
    words = text.split()
    return "\n".join(mark + " ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_notices_wrapped_over_lines(spark):
    texts = [wrapped(t, n) for _, t in TEMPLATES for n in (3, 7)]
    got = labels(spark, *texts, "word " * 5000 + "\n" + wrapped(TEMPLATES[9][1], 6, " * ") + "\n" + "word " * 5000)
    want = [label for label, _ in TEMPLATES for _ in (3, 7)] + ["gpl-3"]
    # the notice of CC BY-NC holds every word of that of CC BY
    assert got == ["cc-by,cc-by-nc" if t.startswith("# This work is") and "NonCommercial" in t else w for t, w in zip([*texts, ""], want, strict=True)]


def test_windows_at_every_place(spark):
    notice = wrapped(TEMPLATES[10][1], 5)
    assert labels(spark, *["x " * n + notice + " y" * 200 for n in range(0, 130, 3)]) == ["bsd"] * 44


def test_words_that_tell_a_license_from_its_kin(spark):
    scattered = [w for t in TEMPLATES for w in t[1].split()]
    assert labels(spark, "Released under the GPL License.", TEMPLATES[7][1], "Licensed under CC BY 4.0.", TEMPLATES[8][1].replace("3", "2"), (" pad" * 60).join(scattered)) == ["", "cc-by", "", "", ""]
