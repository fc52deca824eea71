import os
import random

import pytest

from corvina.llm import encoding as E
from corvina.llm import mixing as M
from corvina.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(T.TOKENIZER_DIR, T.VOCABULARY)), reason="no vocabulary files")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts():
    rnd = random.Random(3)
    alphabet = " 'relvstdm\n\t1a é日!x  "
    out = ["", "<|endoftext|> hi", "we'll don't they're", "a" * 3000, " " * 900 + "x", "\n\n'e", "we'll" * 300, "'" * 700, "日本" * 300, "é" * 500]
    return out + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(120)]


@pytest.mark.parametrize(("leaf", "window"), [(1, 1), (7, 2), (50, 8), (16_384, 64)])
def test_tree_equals_direct_encoding(leaf, window):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(os.path.join(T.TOKENIZER_DIR, "byte_bpe_50k.json"))
    direct.encode_special_tokens = True
    coder = T.TreeEncoder(leaf=leaf, window=window)
    for t, e in zip(texts(), direct.encode_batch(texts(), add_special_tokens=False)):
        ids = coder.encode(t)
        assert ids == e.ids, t[:60]
        assert T.decode_ids(ids, coder) == t


def test_most_documents_are_joined():
    rnd = random.Random(4)
    words = ["lorem", "ipsum", "l'été", "naïve", "42", "—", "don't", "Größe"]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(40, 400))) for _ in range(40)]
    coder = T.TreeEncoder()
    for t in docs:
        before = coder.joins
        assert coder.encode(t) == coder.codec.encode_ordinary(t)
        assert coder.joins > before
    small = T.TreeEncoder(leaf=3, window=2)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "'", "s", " ", "  ", "\n", "1", "é", "日", "!", "'ll", " \t", "\x1c", "\u00a0", "Ж", "…", " b"]) for _ in range(rnd.randrange(1, 60)))
        assert small.encode(t) == small.codec.encode_ordinary(t), repr(t)


def test_decoding_up_the_tree(spark):
    texts = ["hello world", "", "日本語 é" * 200, "a " * 5000]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in T.decode_corpus(T.encode_corpus(df)).collect()}
    assert got == {**dict(enumerate(texts)), 9: ""}


def test_corpus(spark):
    df = spark.createDataFrame([(1, "hello", "z"), (2, None, "z"), (3, "", None), (4, "a " * 60_000, "z")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    assert got[2] == got[3] == [] and got[1] and len(got[4]) > 50_000
    assert T.encode_corpus(df.where("false")).count() == 0


def test_water_fill():
    assert M.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}) == {"a": 10, "b": 90}
    assert M.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert M.water_fill(100, {"a": 0.5, "b": 0.0}, {"a": 500, "b": 20}) == {"a": 100, "b": 0}
    assert M.water_fill(0, {}, {}) == {}
    rnd = random.Random(2)
    for _ in range(200):
        w = {s: rnd.random() for s in "abcde"}
        caps = {s: rnd.random() * 50 for s in "abcde"}
        got = M.water_fill(60, w, caps)
        assert sum(got.values()) == pytest.approx(min(60, sum(caps.values())))
        assert all(got[s] <= caps[s] + 1e-9 for s in got)
        free = [s for s in got if got[s] < caps[s] - 1e-9]
        assert len({round(got[s] / w[s], 6) for s in free}) <= 1  # the rest shares in proportion


def test_draw(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(2000)] + [(9999, None, 50)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("c", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = M.plan(docs, targets)
    got = M.draw(spark, docs, plan).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.repeats <= 3 for r in got)
    for p in plan:
        assert abs(sum(r.tokens * r.repeats for r in got if r.source == p["source"]) - p["allotted"]) <= 20
    assert rows(M.draw(spark, docs, plan)) == rows(M.draw(spark, docs.repartition(7), plan))  # seeded, whatever the partitions
    assert M.draw(spark, docs.where("false"), M.plan(docs.where("false"), targets)).count() == 0


def test_documents_of_no_token_keep_the_cap(spark):
    docs = spark.createDataFrame([(i, "a", 0) for i in range(10)] + [(10, "a", 10), (11, "b", 40)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = M.draw(spark, docs, M.plan(docs, targets)).collect()
    assert max(r.repeats for r in got) == 1 and len({r.doc_id for r in got}) == len(got)


CLEAN = ["L’été a été très élevé à Évry.", "La niñez cambió más rápido.", "Größe und Prüfung für Gewässer", "Показано, что новая модель", "“The plasma” – rather than the dialect – explains", "Ça n’exclut pas un théâtre hétérogène."]


def corpus():
    return [f"{a} {b}" for a in CLEAN for b in CLEAN] * 12


def repairer(docs):
    from collections import Counter

    n = Counter()
    for t in docs:
        n.update(set(t) | {t[i : i + 2] for i in range(len(t) - 1) if not t[i : i + 2].isascii()})
    return E.Repairer(dict(n), len(docs))


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"])
def test_round_trip(codec):
    fix = repairer(corpus())
    for t in CLEAN:
        try:
            bad = t.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        assert fix.mend(bad)[0] == t
    assert fix.mend(CLEAN[0].encode().decode("latin-1").encode().decode("latin-1"))[0] == CLEAN[0]


def test_clean_text_is_left():
    fix = repairer(corpus())
    for t in [*CLEAN, "plain", "Tree: ├── data", "été décomposé", "&eacute;t&eacute;"]:
        new, used, lost = fix.mend(t)
        assert new == t and not used and not lost
    assert fix.mend("l�t�")[2]


def test_find_garbled(spark):
    bad = CLEAN[0].encode().decode("cp1252", "replace").replace("�", "")
    data = [(i, t, "x") for i, t in enumerate(corpus())] + [(9001, "un Ã©tÃ© trÃ¨s Ã©levÃ©", "x"), (9002, None, "x"), (9003, "", "x"), (9004, bad, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, mapping string")
    got = {r.doc_id: r.text for r in E.find_garbled(spark, df).collect()}
    assert got[9001] == "un été très élevé" and set(got) == {9001, 9004}
    assert E.find_garbled(spark, df.where("false")).count() == 0


def test_segments_are_the_maximal_ones():
    assert E.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]
    assert E.segments([]) == [] and E.segments([-1, -2]) == []
