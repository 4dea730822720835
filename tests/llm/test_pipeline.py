"""The pipeline on a small corpus: every stage against its plain version."""

import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    rows, labels, passage = [], [], text(50)
    for i in range(260):
        w = text(r.randint(20, 90))
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
        if i % 9 == 4:
            w[5:5] = passage
        rows.append(" ".join(w))
        labels.append((i, 1, toxic))
    for i in range(1, 40):  # copies and near copies
        w = rows[i].split()
        if i % 2:
            w[-1] = "changed"
        rows.append(" ".join(w))
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*rows, None, ""])], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {i for i, _, t in labels if t} | {300 - 40 + i - 1 for i in range(1, 40) if rows[i][1] and i % 5 == 0}
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
        if name != "encoding":
            assert at.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id: r.text for r in seen["toxicity"]}
    assert not toxic & set(left) and len(left) == len(rows) - len(toxic)
    kept = {i for i, _, _, k in brute.near_dup(sorted(left.items())) if k}
    assert {r.doc_id for r in seen["near_duplicates"]} == kept
    wanted = {i: (cut, sha) for i, _, cut, sha in [(a, b, c, d) for a, b, c, d in brute.substring([(i, left[i]) for i in sorted(kept)])]}
    assert {r.doc_id: brute.sha(" ".join(r.text.split()).encode()) for r in seen["repeated_passages"]} == {i: s for i, (_, s) in wanted.items()}
    assert all(r.text == (left[r.doc_id] or "") for r in seen["repeated_passages"] if not wanted[r.doc_id][0])
    sizes = {r.doc_id: len(r.text.split()) for r in seen["repeated_passages"]}
    assert sum(sizes[r.doc_id] for r in seen["mixing"]) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda t: hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert sorted((r.doc_id, ids(r.text)) for r in seen["mixing"]) == sorted((r.doc_id, r.ids_sha256) for r in seen["encoding"])
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in seen["encoding"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, seen["encoding"]))


def test_odd_rows(spark, tmp_path):
    """Null ids, equal ids with other texts, layout, clashing columns, and an empty table."""
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, own = text(40), text(60)
    rows = [(None, "\n a  b\n\tc\n" + text(60)), (None, text(60)), (3, "x  y\n\n" + text(50)), (3, "an earlier\none " + text(50)), (4, f"head\n\n{passage}\n tail  {own}\n"), (5, f"top {passage} {own[::-1]}"), (6, None), (7, ""), (8, " \n")]
    data = [(i, t, "en", "s", 1, 0.5, "z") for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, mark string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        seen = {}
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(tmp_path))
            path = f"{tmp_path}/{name}-{table is docs}"
            at.write.parquet(path)
            at = spark.read.parquet(path)
            seen[name] = at.collect()
            if name != "encoding":
                assert at.columns == corpus_pipeline.COLUMNS
        if table is not docs:
            assert not any(seen.values())
            continue
        assert len(seen["toxicity"]) == 9
        assert sorted(x.text for x in seen["near_duplicates"] if x.doc_id == 3) == [rows[3][1]] and len(seen["near_duplicates"]) == 8
        kept = {x.text for x in seen["repeated_passages"]}
        assert {rows[0][1], rows[1][1], rows[3][1], f"head\n\ntail  {own}\n", f"top {own[::-1]}"} <= kept
        assert {x.text for x in seen["mixing"] if x.doc_id is None} <= {rows[0][1], rows[1][1]}
