"""The near-copy stage finds pairs by SimHash, whatever MinHash finds."""

from test_neardocs import planted

from folioscope.llm import neardocs, simhash
from folioscope.llm.common import Shared


def test_fingerprints_find_copies_of_their_own(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").repartition(3)
    prints = {r.fp for r in simhash.fingerprints(docs, 5).collect()}
    near = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(near) >= 10
    sets = spark.createDataFrame([(p, p) for p in prints], "fp long, print long")
    got = {(min(r), max(r)) for r in map(tuple, neardocs._print_pairs(Shared(spark), sets).collect())}
    assert got <= near and {x for p in near for x in p} == {x for p in got for x in p}
