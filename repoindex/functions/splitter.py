"""Recursive text splitting into overlapping chunks, on spans of one text.

The separator stays at the start of the piece it opens, so every piece is a contiguous span and a
chunk is one slice of the text, stripped.
"""

# Separators, coarse to fine.
DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ""]
PYTHON_SEPARATORS = ["\nclass ", "\ndef ", "\n\tdef "] + DEFAULT_SEPARATORS
JS_SEPARATORS = [
    "\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ",
    "\ncase ", "\ndefault ",
] + DEFAULT_SEPARATORS
TS_SEPARATORS = [
    "\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ",
    "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ",
] + DEFAULT_SEPARATORS

SEPARATORS = {
    "default": DEFAULT_SEPARATORS,
    "python": PYTHON_SEPARATORS,
    "js": JS_SEPARATORS,
    "ts": TS_SEPARATORS,
}


def _pieces(text, start, end, separator):
    """Cut [start, end) before every occurrence of the separator."""
    cuts = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > start:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    cuts.append(end)
    return list(zip(cuts, cuts[1:]))


def _windows(pieces, size, overlap):
    """Greedy windows over adjacent pieces: at most ``size`` long, carrying at most ``overlap`` over."""
    first = 0
    for here, (start, end) in enumerate(pieces):
        if end - pieces[first][0] > size and here > first:
            yield pieces[first][0], start
            while first < here and (start - pieces[first][0] > overlap or end - pieces[first][0] > size):
                first += 1
    if pieces:
        yield pieces[first][0], pieces[-1][1]


def _character_windows(start, end, size, overlap):
    """What ``_windows`` gives for one-character pieces, without making them."""
    while end - start > size:
        yield start, start + size
        start += size - overlap
    yield start, end


def _spans(text, start, end, separators, size, overlap):
    level = 0
    while separators[level] and text.find(separators[level], start, end) < 0:
        level += 1
    if not separators[level]:
        yield from _character_windows(start, end, size, overlap)
        return
    run = []
    for piece in _pieces(text, start, end, separators[level]):
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        yield from _windows(run, size, overlap)
        run = []
        yield from _spans(text, piece[0], piece[1], separators[level + 1:], size, overlap)
    yield from _windows(run, size, overlap)


def split_text(text: str, language: str, size: int, overlap: int) -> list[str]:
    """Chunks of one text, stripped, empty ones dropped. Lengths count code points."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk size")
    chunks = (text[a:b].strip() for a, b in _spans(text, 0, len(text), SEPARATORS[language], size, overlap))
    return [chunk for chunk in chunks if chunk]
