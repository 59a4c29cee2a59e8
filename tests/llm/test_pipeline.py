import hashlib
import re
from collections import Counter

import pytest
import test_linespread
import test_minhash
import test_mixing

from refweave.llm import crf, pieces
from refweave.llm.shared import table

pipeline = pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    docs = docs.union(spark.createDataFrame([(10_001, None, "en", "src1", None), (10_002, "", "en", None, 0), (10_003, "plain words of a short clean text that stays", None, "src1", 44)], docs.schema))
    out = [docs]
    for name, stage in pipeline.STAGES:
        df = stage(spark, out[-1], SF)
        out.append(pipeline.stash(df, name))
        if name != "sentencepiece":
            assert df.columns == docs.columns
    rows = [[tuple(r) for r in d.collect()] for d in out]

    model = crf.fit(docs, table(spark, SF, "labels"))
    good = {r.doc_id for r in crf.score(docs, model, ["doc_id"]).collect() if r.score >= 0.3}
    assert sorted(rows[1], key=repr) == sorted((r for r in rows[0] if r[0] in good), key=repr)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d not in good for d in junk) >= 0.8 * len(junk)

    lines = {d: (t, n) for d, t, n in test_linespread.brute([(r[0], r[3], r[1]) for r in rows[1]], 5)}
    want = []
    for r in rows[1]:
        text, dropped = lines[r[0]]
        if not dropped:
            want.append(r)
        elif re.search(r"[^\x20\x09-\x0D]", text):
            want.append((r[0], text, r[2], r[3], len(text)))
    assert sorted(rows[2], key=repr) == sorted(want, key=repr)

    near = near_at([(r[0], r[1]) for r in rows[2]], pipeline.NEAR)
    assert sorted(rows[3], key=repr) == sorted((r for r in rows[2] if near[r[0]] == r[0]), key=repr)

    before = {r[0]: r for r in rows[3]}
    copies = Counter(r[0] for r in rows[4])
    assert all(before[r[0]] == r for r in rows[4])
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for d, r in before.items()}
    total, taken, largest = Counter(), Counter(), Counter()
    for d, r in before.items():
        total[r[3]] += size[d]
        taken[r[3]] += size[d] * copies[d]
        largest[r[3]] = max(largest[r[3]], size[d])
        assert copies[d] <= 3
    for s, target in test_mixing.brute_targets(dict(total)).items():
        assert abs(taken[s] - target) <= largest[s]

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    names = out[5].columns
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        r, text = dict(zip(names, r)), before[dict(zip(names, r))["doc_id"]][1]
        assert r["ids"] == (None if text is None else library.encode(text))
        assert r["decoded_sha256"] == (None if text is None else hashlib.sha256(text.encode()).hexdigest())


def test_run_and_empty(spark, tmp_path):
    got = pipeline.run(spark, SF)
    assert got.count() > 100 and got.filter("not round_trip").count() == 0
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_rows_and_names(spark):
    base = table(spark, SF, "documents").limit(60).collect()
    clean = table(spark, SF, "documents").join(table(spark, SF, "labels").filter("quality = 1"), "doc_id").orderBy("doc_id")
    long = "\n".join(r.text for r in clean.collect())
    rows = [(*r, "a", "b", 1.5, 7, True) for r in base]
    rows += [(*base[3], "a", "b", 1.5, 7, True)] * 20 + [(20_001, long, "en", "s", len(long), None, None, None, None, None), (base[5].doc_id, "Other words stand here, under an id that is in use.", "en", "s", 50, "x", "y", 0.5, 1, False)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (None, "no id", None, None, 5, None, None, None, None, None), (20_002, "", "en", "s", 0, "a", "b", 1.5, 7, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _maybe string, score double, dropped int, mark boolean")
    now = docs
    for name, stage in pipeline.STAGES:
        before, now = now, pipeline.stash(stage(spark, now, SF), name)
        assert stage(spark, before.limit(0), SF).count() == 0
        if name != "sentencepiece":
            assert now.columns == docs.columns
            gone = Counter(map(repr, map(tuple, now.collect())))
        if name == "quality_classifier":
            assert sum(r[0] == 20_001 for r in now.collect()) == 1
        if name == "minhash_near_dedup":
            assert max(Counter((r.doc_id, r.text) for r in now.filter("doc_id is not null and text <> ''").collect()).values()) == 1
            assert any("under an id that is in use" in (r.text or "") for r in now.collect())
    assert gone and now.filter("not round_trip").count() == 0


def near_at(rows, percent):
    """Smallest key of each row's group at ``percent``, by brute force over all pairs."""
    sets, root = {k: test_minhash.brute_set(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def test_near_dedup_takes_copies_from_0_80(spark):
    texts = []
    for base in range(12):
        words = [f"w{base}x{i}" for i in range(54)]  # 50 shingles; k other words at the end leave 50 - k of 50 + k
        texts += [" ".join(words), " ".join(words[:-4] + ["other"] * 4), " ".join(words[:-5] + ["else"] * 5), " ".join(words[:-6] + ["far"] * 6)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    at80, at85 = near_at([r[:2] for r in rows], 80), near_at([r[:2] for r in rows], 85)
    want = {r[0] for r in rows if at80[r[0]] == r[0]}
    assert want < {k for k, v in at85.items() if v == k}  # some copies lie between
    got = [tuple(r) for r in pipeline.minhash_near_dedup(spark, docs, SF).collect()]
    assert sorted(got) == sorted(r for r in rows if r[0] in want)
