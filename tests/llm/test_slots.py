"""Benchmark copies whose slots differ in places."""

from larder.llm import decontaminate


def test_copies_with_slots_that_differ(spark):
    filler = "and so the long story goes on without any change at all until the very last of its many quiet pages is read"
    apples = "He gave 3 apples to his old mother and after that he also asked all of his 3 friends to come over for dinner"
    named = f"In spring Alice went down to the river {filler} while later in autumn Alice came back to the house"
    benchmark = spark.createDataFrame([(1, apples), (2, named)], "item_id long, text string")
    rows = [(1, apples.replace("3 apples", "5 apples").replace("3 friends", "7 friends")), (2, named.replace("autumn Alice", "autumn Eve")), (3, "nothing of it")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, benchmark).collect()} == {(1, 1), (2, 2)}
    assert [r["doc_id"] for r in decontaminate.without_leaks(table, benchmark).collect()] == [3]
