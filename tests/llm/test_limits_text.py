"""Long texts, scans cut into other partitions, columns of clashing names."""

import time

from tapeline.llm import crf, grouping


def test_personal_data_time_grows_with_length():
    field = crf.train(crf.labelled_table())
    began = time.time()
    base, spans = crf.all_spans(["1" * 1_000_000, "john@example.com " * 100_000, "1.2.3." * 100_000 + "4"], field)
    assert time.time() - began < 60
    assert base[0] == [] and len(base[1]) == 100_000 == len(spans[1])
    assert base[2][:2] == [("ip", 0, 7), ("ip", 8, 15)] and len(base[2]) == 75_000


def test_field_spans_that_touch_patterns_are_left_out():
    field = crf.train(crf.labelled_table())
    texts = ["mail a.b@c.de or password=abc9x and 10.0.0.1, card 4111 1111 1111 1111 tel +49 30 123456 " * k for k in (1, 7)]
    for text, base, spans in zip(texts, *crf.all_spans(texts, field)):
        extra = [s for s in spans if s not in base]
        assert all(e <= a or b <= s for _, s, e in extra for _, a, b in base)
        assert sorted(base) == sorted(crf.pattern_spans(text))


def test_packing_survives_another_cut_of_the_scan(spark):
    rows = [(i, 0, (i * 7919) % 2048 + 1, "x", 5) for i in range(9_000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, _item string, sequence_id int").repartition(3)
    packed = grouping.pack(pieces, 2048)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.minPartitionNum", "13")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = packed.collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in got) == list(range(9_000)) and {r["_item"] for r in got} == {"x"}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
