"""The pipeline's stages on the smallest tables, each against a plain version over all its rows."""

from collections import Counter

import numpy as np

from screenguard.llm import langid, mixing, pieces, simhash, toxicity
from screenguard.llm.common import remainder, stored, table


def exact_groups(texts, least):
    """All pairs of texts by the exact ratio of their five-word shingles."""
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    out = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if out[a] != out[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                out = [out[b] if x == out[a] else x for x in out]
    return out


def rows_of(docs):
    return Counter(map(tuple, docs.collect()))


def test_stages_by_hand(spark, sf):
    import corpus_pipeline as c

    docs = table(spark, sf, "documents")
    stage = dict(c.STAGES)
    # language: the model's verdict on each text by itself
    model = langid.fit(docs, remainder("id", 3) != 1)
    verdict = {}
    for r in docs.collect():
        (name,), (score,) = model.predict([r["text"] or ""])
        verdict[r["doc_id"]] = name != "und" and score >= model.threshold
    known = stored(stage["language"](spark, docs, sf))
    assert rows_of(known) == Counter({r: n for r, n in rows_of(docs).items() if verdict[r[0]]})
    # toxicity: features and trees of each text by itself
    model = toxicity.fit(known, table(spark, sf, "labels"), remainder("id", 5) != 0)
    analyser = toxicity.Analyser(model.lexicon)
    clean = stored(stage["toxicity"](spark, known, sf))
    place = known.columns.index("text")
    assert rows_of(clean) == Counter({r: n for r, n in rows_of(known).items() if model.score(analyser.features(r[place])[None])[0] < 0.5})
    # near duplicates: all pairs, but for groups that differ between 0.77 and 0.83
    rows = sorted(clean.collect())
    texts = [r["text"] for r in rows]
    one = stored(stage["near_duplicates"](spark, clean, sf))
    kept = {r["doc_id"] for r in one.collect()}
    loose, firm = exact_groups(texts, 0.77), exact_groups(texts, 0.83)
    for g in set(firm):
        assert sum(rows[i]["doc_id"] in kept for i, x in enumerate(firm) if x == g) <= 1
    for g in set(loose):
        assert any(rows[i]["doc_id"] in kept for i, x in enumerate(loose) if x == g)
    if loose == firm:
        assert kept == {rows[firm.index(g)]["doc_id"] for g in set(firm)}
    # mix: every row as often as its copies say
    mixed = stored(stage["mix"](spark, one, sf))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(one).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    # encode: every text back from its pieces, unit by unit
    model = pieces.load()
    table_ = {p: (i, x) for p, i, x in model.pieces}
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    got = stage["encode"](spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in mixed.collect())
    decoder = pieces.Decoder(model.by_id)
    for r in got:
        assert r["roundtrip"] and decoder.text(np.array(r["ids"])) == (text[r["doc_id"]] or "")
        score = {i: x for i, x in table_.values()}
        assert len(r["ids"]) == r["n_tokens"] and all(i in score or model.bytes_from <= i < model.bytes_from + 256 for i in r["ids"])


def test_stages(spark, sf):
    import corpus_pipeline as c

    docs = table(spark, sf, "documents")
    before = docs.count()
    for k, (name, stage) in enumerate(c.STAGES):
        out = stored(stage(spark, docs, sf))
        if k < 4:
            assert out.columns == docs.columns, name
            ids = docs.select("doc_id").distinct()
            assert out.join(ids, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert out.select("text").distinct().count() == out.count() == out.select("doc_id").distinct().count()
        if name == "language":
            assert out.count() >= 0.97 * before
        docs = out
    assert docs.where("not roundtrip").count() == 0 and docs.count() > before


def test_pipeline_on_no_documents(spark, sf):
    import corpus_pipeline as c

    docs = table(spark, sf, "documents").where("false")
    for _, stage in c.STAGES:
        docs = stored(stage(spark, docs, sf))
    assert docs.count() == 0
