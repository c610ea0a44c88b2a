"""What counts as a letter for language identification."""

from freshet.llm import language


def test_symbols_above_the_first_plane_are_no_letters():
    for text in ("\U0001f600 123 \U0001f680!", "\U0001f44d\U0001f3fd", "\U0001d7d8\U0001d7d9", "\U0010ffff"):
        assert language.term_counts(text.encode()) is None
    for text in ("\U00020000", "\U00010400 1", "\U0001f600 a"):
        assert language.term_counts(text.encode()) is not None
    assert [x.tolist() for x in language.term_counts("a \U0001f600 b".encode())] == [x.tolist() for x in language.term_counts(b"a . b")]
