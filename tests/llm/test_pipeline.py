import corpus_pipeline
from siltstone.llm import quality
from siltstone.llm.common import table

from .test_dedup import brute_near
from .test_text import brute_hits
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_and_their_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from siltstone.llm import tokens

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    scores = quality.scores(docs, table(spark, SF, "labels")).collect()
    left = {r.doc_id: rows[r.doc_id] for r in scores if r.predicted}
    last = {t: k for k, t in sorted(left.items())}
    left = {k: left[k] for k in last.values()}
    left = {k: left[k] for k, (_, c) in brute_near(list(left.items())).items() if c == k}
    hit = {k for k, _ in brute_hits(list(left.items()), [tuple(r) for r in table(spark, SF, "benchmark").collect()])}
    left = {k: t for k, t in left.items() if k not in hit}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(left)
    library = Tokenizer.from_file(tokens.vocabulary_path())
    check_pieces(pieces, [(k, library.encode(t, add_special_tokens=False).ids + [1]) for k, t in left.items()])


def test_stages_take_hostile_and_empty_tables(spark, hostile, empty):
    for docs in (hostile, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_registration():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in found if name.startswith("op") and name[2].isdigit()}
    assert "pipeline" in found and set(entry.oracle_sql()) <= set(found)


class Recorded:
    """Stands in for a table: gives the function that it would run in Python workers."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_steps_release_the_words_of_the_packing_before(spark):
    """Workers are reused: what packing keeps in them must not add to the memory of the other steps."""
    import pyarrow as pa

    from siltstone.llm import decontaminate, minhash, tokens

    coder = tokens.encoder(tokens.vocabulary_path())
    one = {"key": [1], "i": [0], "j": [0], "id": [1], "label": [1], "side": [0]}
    task = pa.table(one | {"shingles": pa.array([[1, 2]], pa.list_(pa.int64()))})
    steps = [
        lambda: list(quality.feature_table(Recorded(), "doc_id", "text")(iter([]))),
        lambda: list(minhash.sketches(Recorded(), 5, 40, 4)(iter([]))),
        lambda: minhash._search(75)(task),
        lambda: list(decontaminate._hits_of([(1, "an item")])(iter([]))),
    ]
    for step in steps:
        before = coder.encode(["some words\nof a text"])
        assert len(coder.known) > 1
        step()
        assert len(coder.known) == 1
        assert coder.encode(["some words\nof a text"]) == before
