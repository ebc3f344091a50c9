"""The whole pipeline against plain versions of its stages, on documents of which some are toxic, copies, leaks or repeat passages."""

import random

import numpy as np
import pytest
from tests.llm.test_text_operators import brute_leaks, brute_spans

from graphloom.llm import bpe, decontaminate, simhash, toxicity


def documents():
    r = random.Random(77)
    word = lambda: f"w{r.randrange(3000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)) + ". "
    text = lambda: "".join(sentence(r.randint(6, 14)) for _ in range(r.randint(3, 9)))
    passage = "".join(sentence(11) for _ in range(6))
    items = [(i, sentence(25)) for i in range(4)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = text()
        if bad:
            t = " ".join(x if r.random() > 0.12 else r.choice(["idiot", "moron", "zorgling", "you scum"]) for x in t.split())
        rows.append((i, t))
        labels.append((i, 1, int(bad)))
    rows += [(500 + i, rows[i][1]) for i in range(1, 20)]  # copies
    for i in range(21, 40):  # near copies
        w = rows[i][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((500 + i, " ".join(w)))
    rows += [(600 + i, text() + passage + text()) for i in range(6)]
    rows += [(700 + i, text() + items[i % 4][1] + text()) for i in range(6)]
    rows += [(None, text()), (None, rows[7][1]), (None, items[1][1]), (800, None), (801, ""), (802, "?!"), (803, rows[8][1]), (803, text()), (804, "x " * 140_000)]
    return rows, labels, items


def plain_near(rows, sig):
    """One row of each group of texts within the distance, by a search through all pairs."""
    bits = {k: np.unpackbits(np.array(v, np.int64).view(np.uint8)) for k, v in sig.items()}
    order = sorted({(i is None, i or 0, tid, i, t) for (i, t), tid in rows if (i, t) in bits}, key=lambda x: x[:3])
    group = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            if (bits[order[a][3:]] != bits[order[b][3:]]).sum() <= simhash.MAX_DISTANCE:
                old, new = sorted((group[a], group[b]))[::-1]
                group = [new if g == old else g for g in group]
    stays = {order[g][3:] for g in set(group)}
    out, seen = [], set()
    for (i, t), _ in rows:
        if (i, t) in bits:
            if (i, t) not in stays or (i, t) in seen:
                continue
            seen.add((i, t))
        out.append((i, t))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    import corpus_pipeline
    from graphloom.llm import store

    rows, labels, items = documents()
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    # toxicity: the model, itself held against loops elsewhere, on one row at a time
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(i, t) for i, t in rows if t is None or model.predict([t])[0] < 0.5]
    assert 40 < len(rows) - len(kept) < 120
    # near duplicates: all pairs of signatures
    table = spark.createDataFrame(kept, "doc_id long, text string")
    sig = {(x["doc_id"], x["tid"]): [x[f"s{k}"] for k in range(4)] for x in simhash.signatures(table, null_ids=True).collect()}
    tid = {(x["doc_id"], x["text"]): x["k"] for x in table.withColumn("k", store.text_key(table["text"])).collect()}
    kept = plain_near([((i, t), tid[i, t]) for i, t in kept], {(i, t): sig[i, tid[i, t]] for i, t in kept if (i, tid[i, t]) in sig})
    # spans, which go by id and then text key
    order = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, tid[x]))
    left = brute_spans([((i, t), t) for i, t in order])
    kept = [(i, None if t is None else left[i, t]) for i, t in kept]
    assert sum(len(t or "") for _, t in kept) < sum(len(t or "") for _, t in order)
    # decontamination
    leaked = {n for n, _ in brute_leaks([(n, t) for n, (_, t) in enumerate(kept)], items, decontaminate.N, decontaminate.THRESHOLD)}
    assert len(leaked) >= 6
    kept = [x for n, x in enumerate(kept) if n not in leaked]
    # encoding
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_vocabulary())}, special_tokens={})
    want = sorted(str((i, None if t is None else enc.encode_ordinary(t))) for i, t in kept)
    got = sorted(str((x["doc_id"], None if x["ids"] is None else list(x["ids"]))) for x in corpus_pipeline.run(spark, folder).collect())
    assert got == want
