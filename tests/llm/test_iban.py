"""Account numbers before capitals and digits, and beside each other."""

from __future__ import annotations

from gleaner.llm import pii


def test_ibans_end_where_their_country_says(spark):
    texts = [
        ("ES91 2100 0418 4502 0005 1332 Please", ["iban:0:29"]), ("BE68539007547034 Bank", ["iban:0:16"]), ("AT611904300234573201 2024", ["iban:0:20"]),
        ("pay to NO9386011117947 A", ["iban:7:22"]), ("BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00 OK", ["iban:0:19", "iban:20:47"]),
        ("XX12 GB82 WEST 1234 5698 7654 32", ["iban:5:32"]), ("BE68539007547034X", []), ("ES91 2100 0418 4502 0005 1333 Please", []),
        ("GB82 WEST 1234 5698 7654 32 2024 A", ["iban:0:27"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.digests(pii.find_spans(df)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}


def test_context_words_are_whole_words(spark):
    texts = ["security 123-45-6789", "insecurity 123-45-6789", "123-45-6789 (ssn)", "the lessn 123-45-6789", "SSN:123-45-6789", "BE68 5390 0754 7034 EUR", "NO93 8601 1117 947"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_ssn, r.n_iban) for r in pii.digests(pii.find_spans(df)).collect()}
    assert got == {0: (1, 0), 1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (1, 0), 5: (0, 1), 6: (0, 1)}
