from collections import Counter

import corpus_pipeline

from .conftest import frame, prose


def test_one_row_of_each_group_stays(spark):
    one, two, copied, low, high = (prose(300 + k, 80) for k in range(5))
    rows = [(2, one, "a"), (2, two, "a"),                                        # one id, unlinked texts
            (3, prose(310, 50), "a"), (3, "", "a"), (3, None, "a"),              # a text and empty ones
            (None, copied, "a"), (None, copied + " tail", "a"), (None, copied, "a"),     # copies without ids
            (None, low, "a"), (5, low + " more", "a"), (None, high, "a"), (7, high, "a"), (7, high, "a"), (8, high, "a")]
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    without_id = [k for k in got if k[0] is None]
    assert len(without_id) == 1 and without_id[0][1] in (copied, copied + " tail")
    assert got == Counter([(2, one), (2, two), (3, prose(310, 50)), (3, ""), (5, low + " more"), (7, high), without_id[0]])
