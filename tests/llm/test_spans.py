from tessera.llm import sentence_spans

from .conftest import frame


def sentence(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n - 1)) + f" {name}end."


def test_both_ends_of_a_passage_are_covered(spark):
    passage = " ".join(sentence(name, n) for name, n in (("a", 20), ("b", 35), ("c", 8)))
    rows = [(k, f"{sentence(f'u{k}', 25)} {passage} {sentence(f'v{k}', 25)}", "a") for k in (1, 2)]
    rows += [(3, f"{sentence('u3', 25)} {passage}", "a"), (4, passage, "a")]
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in sentence_spans.repeated_sentences(frame(spark, rows), both_ends=True).collect()}
    assert got == {1: [], 2: [(1, 4)], 3: [(1, 4)], 4: [(0, 3)]}


def test_each_repeated_sufficient_run_is_covered():
    parts = [[b"w"] * n for n in (3, 2, 9, 1, 40, 5, 2, 2, 30, 4, 7)]

    def enough(s, e):
        n = sum(map(len, parts[s:e]))
        return n >= sentence_spans.MIN_WORDS and e - s >= sentence_spans.SEVERAL or n >= sentence_spans.ALONE_WORDS

    hashed = [(s, e) for s, e, _ in sentence_spans.runs(parts)]
    assert all(enough(s, e) for s, e in hashed) and len(hashed) == len(set(hashed)) <= 2 * len(parts)
    for s in range(len(parts)):
        for e in range(s + 1, len(parts) + 1):
            if enough(s, e):
                inside = {k for a, b in hashed if s <= a and b <= e for k in range(a, b)}
                assert inside == set(range(s, e))
