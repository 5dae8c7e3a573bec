"""Rows that are hard on operators: null, empty, blank, very long, repeated, without an id."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside must not clash with those of the input.
CLASH = ["fp", "tid", "k", "words", "w", "_w", "_t", "_secrets", "r", "h", "pos", "term", "kept", "cover", "runs", "root", "ids", "n_words"]
LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(12_000))


def rows():
    base = "the quick brown fox jumps over the lazy dog near the river bank while children play in the warm summer sun "
    body = " ".join(f"{base.split()[i % 20]}{i % 7}" for i in range(140))
    return [
        (1, body, "en", "a", len(body)),
        (2, body, "en", "a", len(body)),
        (3, body.replace("quick1", "slow"), "en", None, 1),
        (4, "", "en", "b", 0),
        (5, None, None, None, None),
        (6, "   \n\t ", "de", "b", 6),
        (7, "Ünïcödé 日本語 <|endoftext|> 'tis", "fr", "b", None),
        (8, LONG, "en", "c", len(LONG)),
        (9, "one two", "en", "c", 7),
        (9, "one two", "en", "c", 7),
        (None, body, "en", "c", 3),
        (10, "\x00\x1c a b \x85 c d", None, "c", 3),
    ]
