"""Near-duplicates are dropped by row, not by id."""

from stratasieve.llm import near_dedup as nd


def test_texts_of_one_id_are_decided_alone(docs):
    words = lambda x: " ".join(f"{x}{k}" for k in range(40))
    rows = [(1, words("a")), (4, words("a")), (4, words("b")), (7, words("c")), (7, words("d")), (7, words("d")), (9, words("b")), (None, words("a"))]
    got = nd.drop_near_duplicates(docs([(i, t, "en", "s") for i, t in rows]))
    want = [(1, words("a")), (4, words("b")), (7, words("c")), (7, words("d")), (None, words("a"))]
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
