"""Each stage of the corpus pipeline against a brute-force version, on its own input."""

import corpus_pipeline as cp
import numpy as np
import pytest

from skerry.llm import pii, toxicity
from skerry.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows that each stage gets and gives, written and read again as a driver would."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        new = spark.read.parquet(str(folder / name))
        out.append((docs, new))
        docs = new
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for docs, new in stages[:-1]:
        assert new.dtypes == docs.dtypes
        assert new.where("n_chars != length(text)").isEmpty()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "personal data", "packing"]


def test_toxicity_stage(spark, sf, stages):
    docs, new = stages[0]
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = lexicon.automaton()
    assert set(texts(new)) == {i for i, t in texts(docs).items() if lexicon.score(t or "", a)[2] < 0.3}


def test_near_duplicate_stage(stages):
    docs, new = stages[1]
    sets = {}
    for i, t in texts(docs).items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert set(texts(new)) == {i for i in sets if label[i] == i}
    assert texts(new) == {i: t for i, t in texts(docs).items() if label[i] == i}


def test_passage_stage(stages):
    docs, new = stages[2]
    seen, want = set(), {}
    for i, t in sorted(texts(docs).items()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            x = tuple(w[a : a + 20])
            if x in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(x)
        want[i] = b" ".join(y for y, g in zip(w, gone) if not g).decode() if any(gone) else t
    assert texts(new) == want


def test_personal_data_stage(stages):
    docs, new = stages[3]
    there = pii.Pseudonyms(cp.PII_KEY)
    assert texts(new) == {i: t and there(t)[0] for i, t in texts(docs).items()}
    assert any(a != b for a, b in zip(texts(docs).values(), texts(new).values()))


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    docs, new = stages[4]
    tok = Tokenizer.from_file(vocabulary_path())
    rows = new.collect()
    sizes = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts(docs).items()}
    got = dict.fromkeys(sizes, 0)
    bins = {}
    for r in rows:
        got[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == sizes
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 1024
    assert len(bins) <= 1.05 * -(-sum(sizes.values()) // 1024) + 1
