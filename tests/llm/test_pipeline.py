import corpus_pipeline as P
from awkward import AWKWARD

SF = "/root/testdata/sf0.001"


def test_stages_bear_awkward_rows_and_empty_tables(spark, docs):
    rows = AWKWARD + [(i, f"some english text number {i} that is long enough to be told apart from all the others") for i in range(20)]
    for df in (docs(rows), docs([])):
        for name, stage in P.STAGES:
            got = stage(spark, df, SF)
            if name != P.STAGES[-1][0]:
                assert got.columns == P.COLUMNS
            df = P.stored(got)
            df.count()


def test_only_equal_or_linked_texts_go(spark, docs):
    """Rows that share an id or have none are judged by their texts."""
    one, far = "a b c d e f g", "unrelated words stand here alone today"
    rows = [(5, one), (5, one), (5, "h i j k l m n"), (6, "A b c d e f g"), (7, far), (3, "h i j k  l m n"), (None, one), (None, "no id o p q r s"),
            (None, "no id o p q r s"), (None, None), (8, ""), (8, ""), (9, "")]
    got = P.one_of_each_group(spark, docs(rows), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(
        [(3, "h i j k  l m n"), (5, one), (7, far), (None, "no id o p q r s"), (None, None), (8, ""), (9, "")], key=repr)
