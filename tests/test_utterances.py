"""Labels and parameters of questions."""

import pytest

from twinfold.operators import utterances as ut

CASES = [
    # text, intent, resolved, param1, param2
    ("Hello there", "greet", "greet", None, None),
    ("goodbye", "goodbye", "goodbye", None, None),
    ("help", "help", "help", None, None),
    ("show stats", "stats", "stats", None, None),
    ("statistics please", "search", "search", "statistics", None),
    ("duplicates between john and jane", "cross_user_dups", "cross_user_dups", "john", "jane"),
    ("duplicates of user bob", "cross_user_dups", "cross_user_dups", "bob", None),
    ("duplicates between friends", "cross_user_dups", "cross_user_dups", None, None),
    ("Ann and Bob duplicates for users", "cross_user_dups", "cross_user_dups", "ann", "bob"),
    ("show duplicates", "alerts", "alerts", None, None),
    ("pdf files from john today", "by_date_today", "by_date_today", None, None),
    ("files this   week", "by_date_week", "by_date_week", None, None),
    ("files last month", "by_date_last_month", "by_date_last_month", None, None),
    ("files larger than 1MB", "by_size_gt", "by_size_gt", "1048576", None),
    ("500 kb or more", "by_size_gt", "by_size_gt", "512000", None),
    ("larger than 1.5 kb", "by_size_gt", "by_size_gt", "1536", None),
    ("files > 1mb", "search", "search", "1mb", None),
    ("size > 10", "by_size_gt", "search", "size 10", None),
    ("size > 2gb", "by_size_gt", "by_size_gt", "2147483648", None),
    ("show all PDFs", "by_type", "by_type", "pdf", None),
    ("find txt files from john", "by_type", "by_type", "txt", None),
    ("wav recordings", "search", "search", "wav recordings", None),
    ("files from user john", "by_user", "by_user", "john", None),
    ("show john's files", "by_user", "by_user", "john", None),
    ("johns files", "by_user", "by_user", "john", None),
    ("files from all", "by_user", "search", "from", None),
    ("show all files", "list_all", "list_all", None, None),
    ("list downloads", "list_all", "list_all", None, None),
    ("search invoice", "search", "search", "invoice", None),
    ("find the file", "search", "search", "find the file", None),
    ("one two three four five six", "search", "search", "one two three four five", None),
    ("  ", None, None, None, None),
    ("zażółć gęślą", "search", "search", "zażółć gęślą", None),
    ("éhi", "search", "search", "éhi", None),
    ("müller's files", "by_user", "search", "müller s", None),
    ("duplicates between zoë and ann", "cross_user_dups", "cross_user_dups", None, None),
]


def test_routing(spark):
    log = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, text string")
    found = {r.id: (r.intent, r.resolved, r.param1, r.param2) for r in ut.utterance_routed(log).collect()}
    wrong = {CASES[i][0]: (found[i], CASES[i][1:]) for i in found if found[i] != CASES[i][1:]}
    assert not wrong


@pytest.mark.parametrize("text,want", [("10 b", 10), ("no size", None), ("7 tb", None), ("99999999999999999999 gb", None), ("9 gb", 9 * 1024**3)])
def test_size(spark, text, want):
    log = spark.createDataFrame([(1, text)], "id long, text string")
    assert ut.utterance_parameters(log).first().min_bytes == want


def test_counts(spark):
    log = spark.createDataFrame([(1, "help"), (2, "help me"), (3, "bye")], "id long, text string")
    assert {r.intent: r.n for r in ut.intent_counts(log).collect()} == {"help": 2, "goodbye": 1}


def test_show_x_counts_as_a_user(spark):
    log = spark.createDataFrame([(1, "show alice"), (2, "show my files")], "id long, text string")
    assert {r.id: r.user_name for r in ut.utterance_parameters(log).collect()} == {1: "alice", 2: None}
