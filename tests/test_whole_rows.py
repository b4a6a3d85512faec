"""Queries over small fixtures against brute force: no row or text is left out."""

from tessellar.plans import relational, text


def test_profile_sample_takes_whole_texts(spark, tmp_path):
    docs = [(i, f"{i} " + "word, " * (i % 7 + 4) + f"end {i}", "en", f"src{i % 2}", 0) for i in range(130)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for title in ("src0", "src1"):
        own = sorted((d for d in docs if d[3] == title), key=lambda d: (d[0] % 50 + 1 > 4, d[0] % 8, d[0]))[:40]
        expected[title] = (" ".join(d[1] for d in own), 40)
    assert {r.title: (r.sample, r.n) for r in relational.profile_sample_whole(spark, str(tmp_path)).collect()} == expected


def test_section_paths_take_every_line(spark, tmp_path):
    lines = [(order, n, (order * 5 + n * 3) % 11) for order in (1, 2, 51, 52, 101) for n in range(1, 8)]
    lines += [(order, n, part) for order in (1, 51) for n in (3, 7) for part in (7, 8, 9, 7)]  # order and number repeat in lineitem
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = []
    for document in (1, 2):
        above = []  # (level, title) of the open headings
        for order, n, part in sorted((x for x in lines if x[0] % 50 == document), key=lambda x: (x[0] * 8 + x[1], x[2] % 3, f"h{x[2]}")):
            above = [x for x in above if x[0] < part % 3 + 1] + [(part % 3 + 1, f"h{part}")]
            expected.append((document, order * 8 + n, part % 3 + 1, f"h{part}", [t for _, t in above]))
    got = text.section_paths(spark, str(tmp_path)).collect()
    assert sorted((r.document, r.ord, r.level, r.title, r.path) for r in got) == sorted(expected)
