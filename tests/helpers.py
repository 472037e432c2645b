"""Row comparison and small frames."""

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(frame, *columns):
    """Rows as sorted tuples, columns in the given or in alphabetical order."""
    names = columns or sorted(frame.columns)
    return sorted((tuple(plain(row[n]) for n in names) for row in frame.collect()), key=repr)


POST_COLUMNS = "post_id bigint, thread_id bigint, user_name string, message string, post_date bigint"
THREAD_COLUMNS = "thread_id bigint, title string, last_post_date bigint, node bigint"


def forum(spark):
    """Three threads; the first holds most posts, the last has none."""
    posts = [
        (1, 1, "ann", "the quick brown fox jumps over the lazy dog", 1000),
        (2, 1, "bob", "A quick answer: foxes are quick, quick!", 2000),
        (3, 1, "ann", "nothing to see here", 3000),
        (4, 2, "cid", "Größe und Länge der Tabelle", 4000),
        (5, 2, "bob", "brown the quick", 5000),
    ]
    threads = [(1, "Brown fox facts", 3000, 1), (2, "Tabellen & <Größen>", 5000, 2), (3, "Empty 'thread'", 100, 3)]
    return spark.createDataFrame(posts, POST_COLUMNS), spark.createDataFrame(threads, THREAD_COLUMNS)
