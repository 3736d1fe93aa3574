from hypothesis import given, settings
from hypothesis import strategies as st

from repoindex.functions.splitter import DEFAULT_SEPARATORS, split_text


def test_short_text_is_one_stripped_chunk():
    assert split_text("  hello \n", "default", 100, 10) == ["hello"]
    assert split_text(" \n ", "default", 100, 10) == []


def test_paragraphs_come_first():
    assert split_text("aaaa\n\nbbbb\n\ncccc", "default", 11, 0) == ["aaaa\n\nbbbb", "cccc"]


def test_overlap_carries_whole_words():
    assert split_text("one two three four", "default", 10, 4) == ["one two", "two three", "four"]


def test_a_long_word_is_cut_with_overlap():
    assert split_text("abcdefghij", "default", 4, 1) == ["abcd", "defg", "ghij"]
    assert split_text("x" * 5 + " " + "y" * 5, "default", 4, 0) == ["xxxx", "x", "yyy", "yy"]


def test_emoji_count_as_one():
    assert split_text("\U0001f600" * 5, "default", 4, 0) == ["\U0001f600" * 4, "\U0001f600"]


def test_python_declarations():
    text = "import a\n\nclass A:\n    x = 1\n\ndef f():\n    return 2\n"
    assert split_text(text, "python", 28, 0) == ["import a", "class A:\n    x = 1", "def f():\n    return 2"]


def naive(text, separators, size, overlap):
    """The same rules on lists of strings, without any shortcut."""
    separator = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(separator) + 1:]
    if separator:
        head, *tail = text.split(separator)
        pieces = [p for p in [head] + [separator + t for t in tail] if p]
    else:
        pieces = list(text)
    out, good = [], []

    def merge():
        window = []
        for piece in good:
            if window and len("".join(window)) + len(piece) > size:
                out.append("".join(window))
                while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        if window:
            out.append("".join(window))
        good.clear()

    for piece in pieces:
        if len(piece) < size:
            good.append(piece)
        else:
            merge()
            out.extend(naive(piece, rest, size, overlap) if rest else [piece])
    merge()
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(2, 12), st.integers(0, 5))
def test_agrees_with_naive_rules(text, size, overlap):
    overlap = min(overlap, size - 1)
    want = [c.strip() for c in naive(text, DEFAULT_SEPARATORS, size, overlap)] if text else []
    assert split_text(text, "default", size, overlap) == [c for c in want if c]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(2, 20))
def test_chunks_are_bounded_substrings(text, size):
    for chunk in split_text(text, "ts", size, size // 4):
        assert chunk and len(chunk) <= size and chunk in text
