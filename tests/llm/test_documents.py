import hashlib
import json
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import licenses, linetemplates, media, queries

WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def test_payloads_are_stored_and_read_back(spark):
    rows = [(1, "a" * 64), (2, "a" * 65), (3, None), (4, ""), (5, "é\n\x00<b>&amp;"), (6, "a" * 64), (None, "x"), (7, "y" * 70_000)]
    got = media.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    for i, t in rows:
        data = (t or "").encode()
        full = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert media.from_image(media.to_image(full)) == full and r.caption == ("" if i is None else str(i)) or r.caption is None
    assert by[1].media_sha256 == by[6].media_sha256 and by[1].feature == by[6].feature
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_html_gives_ordered_text_and_media():
    page = """<html><head><title>T</title><script>var x = "<p>";</script></head><body><p>One <b>bold</b></p>
      <figure><img src="a.png" alt="alt a"><img src="sha256:ff"><figcaption>Cap <i>tion</i></figcaption></figure>
      after<video><source src="v.mp4" type="video/mp4"></video><p>Two &amp; three<br>four"""
    items = media.read_html(page)
    assert [i["position"] for i in items] == list(range(len(items)))
    assert [(i["kind"], i["text"], i["caption"]) for i in items] == [
        ("text", "T", None), ("text", "One bold", None), ("image", None, "Cap tion"), ("image", None, "Cap tion"), ("text", "after", None),
        ("video", None, None), ("video", None, None), ("text", "Two & three", None), ("text", "four", None)]
    assert items[3]["digest"] == "ff" and items[2]["digest"] == hashlib.sha256(b"a.png").hexdigest()


def test_references_resolve_by_digest(spark):
    pages = spark.createDataFrame([(1, '<p>x</p><img src="sha256:d1" alt="c"><img src="sha256:d2">'), (2, None)], "page_id long, html string")
    table = spark.createDataFrame([("d1", bytearray(b"data"))], "digest string, media binary")
    got = media.resolve(media.interleave(pages), table).orderBy("id", "position").collect()
    assert [(r.id, r.position, r.kind, r.caption, r.media and bytes(r.media)) for r in got] == [
        (1, 0, "text", None, None), (1, 1, "image", "c", b"data"), (1, 2, "image", None, None)]


def test_license_places(spark):
    mit = licenses.TEMPLATES["MIT notice"]
    broken = mit.replace("free of charge", "without any charge").replace("sublicense, ", "")
    rows = [
        (1, "Some words.\nReleased under the MIT License."), (2, "Nothing to see under the tree"), (3, None), (4, ""), (5, "x " * 9000 + mit.upper() + " tail"),
        (6, broken), (7, mit[: len(mit) // 2]), (None, "All rights reserved. All rights reserved."), (8, "licensed under the apache license version 2 0")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.id or 0, r.template, round(r.coverage, 2)) for r in found)
    assert (1, "MIT line", 1.0) in got and (5, "MIT notice", 1.0) in got and (8, "Apache-2.0 line", 1.0) in got
    assert got.count((0, "Reserved line", 1.0)) == 2
    assert [c for i, t, c in got if i == 6 and t == "MIT notice"][0] > 0.9
    assert not [g for g in got if g[0] in (2, 3, 4) or (g[0] == 7 and g[1] == "MIT notice")]
    text = rows[4][1].encode()
    span = next(r for r in found if r.id == 5 and r.template == "MIT notice")
    assert text[span.first_byte : span.end_byte].decode().startswith("PERMISSION IS") and text[span.first_byte : span.end_byte].decode().endswith("CONDITIONS")


def test_short_templates_are_found_wherever_coverage_holds(spark):
    """Every line of five to fifteen words with as many words replaced as the coverage lets, next to each other or apart; with words put in between."""
    draw, rows, wording = random.Random(5), [], "released under the mit license by its makers in spring for all readers of them".split()
    table = [(f"t{n}", " ".join(wording[:n])) for n in range(3, 16)]
    for n in range(3, 16):
        for _ in range(6):
            words = wording[:n]
            for at in draw.sample(range(n), n // 5):
                words[at] = "other"
            rows.append((n * 100 + len(rows), f"t{n}", " ".join(words)))
    rows.append((9999, "t5", "released x under x the x mit x license"))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {(r.id, r.template) for r in licenses.scan(docs, spark.createDataFrame(table, "template string, text string")).collect()}
    full = set()
    known = {k: licenses._words([v.encode()])[0] for k, v in table}
    for i, _, t in rows:
        text = licenses._words([t.encode()])[0]
        full |= {(i, k) for k, w in known.items() for d in range(-len(w), len(text)) if licenses.align(text, w, d, 4)[0] >= 0.8 * len(w)}
    assert (9999, "t5") in got and len(full) > 78 and got == full


def test_alignment_matches_plain_dynamic_programming():
    draw = random.Random(3)
    for _ in range(40):
        template = np.array([draw.randint(0, 9) for _ in range(draw.randint(3, 12))], np.uint64)
        words = list(template)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.randint(10, 19)
        words = np.array([20] * 5 + words + [21] * 4, np.uint64)
        h = np.zeros((len(template) + 1, len(words) + 1), int)
        for i, t in enumerate(template, 1):
            for j, w in enumerate(words, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if w == t else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        matched, first, end = licenses.align(words, template, 5, 40)
        assert 2 * matched - (len(template) + end - first) <= h.max() and (matched > 0) == (h.max() > 0)


def test_recurring_templates_go_and_first_document_keeps_them(spark):
    draw = random.Random(2)
    prose = lambda: " ".join(draw.choices(WORDS, k=12))
    rows = [(None, "Page 1 of 9 printed by example\nown line of mine"), (50, None), (51, "")]
    for i in range(15):
        rows.append((i, "\n".join([prose(), f"Page {i} of {i + 7} printed by example", "", prose(), "short one", f"{i} {i + 1} {i + 2}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linetemplates.drop_recurring_lines(docs).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = lines if i in (None, 0) else [x for x in lines if not x.startswith("Page")]
        assert got[i].text == (None if t is None else "\n".join(keep))
        assert got[i]["__n_dropped"] == len(lines) - len(keep)
    assert linetemplates.drop_recurring_lines(docs.limit(0)).collect() == []


def _same_template(a: str, b: str) -> bool:
    """Lines of five tokens and more: equal leading tokens, and all others equal outside one field."""
    a, b = ([None if any(ch.isdigit() or ch == "@" for ch in w) or "://" in w else w for w in x.split()] for x in (a, b))
    if len(a) != len(b) or a[:3] != b[:3]:
        return False
    differ = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    width = len(a) // 5
    starts = [min(3 + k * ((width + 1) // 2), len(a) - width) for k in range(len(a))]
    fields = [set(range(s, s + width)) for s in starts]
    return any(set(differ) <= f and any(w is not None for i, w in enumerate(a) if i not in f) for f in fields) or (not differ and any(a))


@pytest.mark.parametrize("parts,min_docs", [(1, 2), (7, 2), (3, 3)])
def test_templates_match_brute_force(spark, parts, min_docs):
    """All pairs of lines, whatever the order and number of partitions; ids are dealt so that smaller ones come later."""
    draw, rows = random.Random(8), []
    for i in range(60):
        lines = []
        for n in (5, 6, 9, 10, 12, 15, 23, 31):
            base = random.Random(n).choices(WORDS, k=n)
            at, wide = draw.randrange(2, n), draw.randint(1, max(1, n // 5))
            base[at : at + wide] = [draw.choice(["x", "y", "7", "z9"]) for _ in base[at : at + wide]]
            if draw.random() < 0.3:
                base[draw.randrange(n)] = draw.choice(WORDS)
            lines.append(" ".join(base))
        lines.append(" ".join(["1"] * 4 + [draw.choice("pq")] * draw.randint(1, 2)))
        rows.append((59 - i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r.text for r in linetemplates.drop_recurring_lines(docs, min_docs=min_docs).collect()}
    held = [(i, x) for i, t in rows for x in t.split("\n")]
    if min_docs == 2:
        gone = {(i, x) for i, x in held if any(j < i and _same_template(x, y) for j, y in held)}
        assert 0 < len(gone) < len(held)
        assert got == {i: "\n".join(x for x in t.split("\n") if (i, x) not in gone) for i, t in rows}
    else:
        assert {i for i, _ in rows} == set(got) and sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)


def test_long_lines_and_one_template_for_a_third_of_all_lines(spark):
    long = " ".join(WORDS * 300)
    rows = [(i, f"alpha beta gamma delta epsilon {WORDS[i]}\n{' '.join(random.Random(i).choices(WORDS, k=9))}\n{long if i % 2 else ''}") for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = linetemplates.drop_recurring_lines(docs).collect()
    assert len(got) == 203
    for r in got:
        lines = rows[r.doc_id][1].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k == 1 or (k == 0 and r.doc_id == 0) or (k == 2 and r.doc_id < 2) or not x)


def test_lines_of_two_documents_short_lines_and_fields_recur(spark):
    rows = [
        (1, "Of.\nan own line of five\nPosted 3 May by 17\nwritten by Ann\n1 2 3\nsame line in two documents\n4 5 6"),
        (2, "Of.\nanother one with six tokens here\nPosted 12 May by 99\nwritten by Bob\n1 2 3\nsame line in two documents\n4 5 7"),
        (3, "And\nthe third text is of seven tokens\nPosted 4 June by 20\nWritten at home by Cy\nnot at all here\n7 8 9"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linetemplates.drop_recurring_lines(docs, min_verbatim=1).collect()}
    assert got == {1: rows[0][1], 2: "another one with six tokens here\n4 5 7", 3: rows[2][1]}
    fields = spark.createDataFrame([(i, f"Posted {i} {i + 1} by {i * 2}\nby {i} {i + 1} {i + 2}\nread by {WORDS[i]} today") for i in range(3)], "doc_id long, text string")
    assert [r.text for r in linetemplates.drop_recurring_lines(fields).orderBy("doc_id").collect()] == [fields.first().text, "", ""]


def test_other_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, None, None, None)], "doc_id long, text string, line long, leaf string")
    got = linetemplates.drop_recurring_lines(docs, min_docs=1)
    assert got.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    assert sorted(map(tuple, got.select(*docs.columns).collect())) == [(1, "a b c d", 5, "x"), (2, None, None, None)]


def test_pipeline_stages_chain(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert set(pieces.doc_id) == {r.doc_id for r in docs.collect()}
    assert pieces.groupby("doc_id").length.sum().sum() == whole.length.sum() and len(key) == 5


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and json.dumps(list(queries.QUERIES))


def test_a_line_meets_its_key_once(spark):
    """A third of all rows under one key, looked up without a shuffle; the joins give each row at most once."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) key", "id", "id * 2 spot")
    table = spark.createDataFrame([(-1, 30, 1000), (4, 4, 1), (7, 5, 1), (8, 9, 1)], "key long, first long, n long")
    got = linetemplates._later(rows, table, 3000)
    assert sorted(r.id for r in got.collect()) == sorted([7, *range(33, 3000, 3)])
    assert got.columns == ["key", "id", "spot"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and "Inner" not in plan
