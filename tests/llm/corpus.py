"""Small tables for the corpus operators: odd rows, copies, shared passages."""

import random

# Extra columns with names that operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key binary, node long,"
    " token string, marks string, bucket int, size long, shard int, n_words long,"
    " __id long, __marks string, __line_doc long, __line_keys string"
)
EXTRA = (b"k", 7, "t", "m", 1, 2, 3, 4, 5, "m", 6, "k")


def table(spark, rows):
    """Rows (doc_id, text) with all columns of documents and the extra ones."""
    full = [
        (doc_id, text, "en", "src0", None if text is None else len(text), *EXTRA)
        for doc_id, text in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvw") + str(rng.randrange(400)) for _ in range(n)]


def edited(rng, tokens, edits):
    tokens = list(tokens)
    for _ in range(edits):
        tokens[rng.randrange(len(tokens))] = "edit" + str(rng.randrange(10**6))
    return tokens


def odd_rows(seed=1):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(seed)
    base, other = words(rng, 120), words(rng, 60)
    passage = " ".join(words(rng, 55))
    line = "A line of more than forty characters, in Many documents."
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three"), (6, "ONE  two\tthree"),
        (7, "é" * 30), (8, "日本語 テキスト " * 8), (9, "x" * 5000), (10, "ab " * 3000),
        (None, "no id " + passage), (None, None), (11, "mit license " * 40),
        (12, "Apache License and the GNU General Public License, version 3. MIT license"),
    ]
    rows += [(13, " ".join(words(rng, 20_000)))] * 2  # long, and a repeated row
    rows += [(20 + n, " ".join(edited(rng, base, n % 7))) for n in range(14)]
    rows += [(40 + n, " ".join(other)) for n in range(4)]
    rows += [(50 + n, " ".join(words(rng, 30)) + "\n" + passage + "\n") for n in range(6)]
    rows += [(60 + n, f"{line if n % 2 else line.upper()}  \nown {n}\n{line}") for n in range(7)]
    rows += [(70, " ".join(base[:100]) + "\r\nend"), (71, "\x1c\x85  ok <|endoftext|> it's")]
    rng.shuffle(rows)
    return rows


def by_id(rows):
    """Result rows by their first column; equal rows of a repeated id are one."""
    found = {}
    for row in rows:
        assert found.setdefault(row[0], row) == row
    return found
