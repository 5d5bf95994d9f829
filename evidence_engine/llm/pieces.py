"""Encoding texts by the pieces between their spaces, each distinct piece of a batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def plain(text: str) -> str:
    """Line breaks as spaces, and lower case where that can't change the ids.

    Lower case comes before composition here, which is the same where there is nothing to compose
    (Latin-1 has no combining marks) and no special token's string can come about.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ")


#: Signs that are neither letters, digits nor white space.
SIGNS = ".,;:!?*$%&#|)]"
#: Longer pieces are encoded each time.
LONGEST = 256


class PieceEncoder:
    """Ids of whole texts from an encoder of pieces, which it asks once for each piece that it doesn't remember.

    The vocabulary's normaliser and pre-tokeniser must not look across spaces and line breaks. Two
    generations of pieces are remembered, each of about keep to twice as many.
    """

    def __init__(self, encode: Callable[[list[str]], list], keep: int = 200_000):
        self.encode, self.keep, self.young, self.old = encode, keep, {}, {}

    def known(self, pieces: list[str]) -> list[bytes]:
        from array import array

        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = [young.get(p) or old.get(p) for p in pieces]
        # A run of letters and the signs behind it are words of their own: the letters are asked for once.
        split, wanted = [], {}
        for k, ids in enumerate(found):
            if ids is None:
                piece = pieces[k]
                letters = piece.rstrip(SIGNS)
                if letters != piece and letters.isalpha():
                    signs = piece[len(letters) :]
                    split.append((k, letters, signs))
                    wanted[letters] = young.get(letters) or old.get(letters)
                    wanted[signs] = young.get(signs) or old.get(signs)
                else:
                    split.append((k, piece, None))
                    wanted[piece] = None
        fresh = [part for part, ids in wanted.items() if ids is None]
        wanted.update(zip(fresh, [array("I", ids).tobytes() for ids in self.encode(fresh)], strict=True))
        for k, piece, signs in split:
            found[k] = wanted[piece] if signs is None else wanted[piece] + wanted[signs]
        if len(young) < 2 * self.keep:
            if max(map(len, wanted), default=0) > LONGEST:
                wanted = {p: ids for p, ids in wanted.items() if len(p) <= LONGEST}
            young.update(wanted)
        return found

    def texts(self, texts: list[str | None]):
        """All ids in one array of uint32, and where each text's end, with a 0 before them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array([plain(t or "") for t in texts], pa.large_string()), " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        parts = self.known(coded.dictionary.to_pylist())
        sizes = np.fromiter((len(p) // 4 for p in parts), "i8", len(parts))
        flat = np.frombuffer(b"".join(parts), "<u4")
        at = coded.indices.to_numpy()
        ends = ends - ends[0]
        n = sizes[at]
        stop = np.concatenate([[0], np.cumsum(n)])
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        place = np.repeat((first[at] - stop[:-1]).astype("i4"), n)
        place += np.arange(len(place), dtype="i4")
        ids = flat[place]
        return ids, stop[ends]


def slices(batch, column: str, most: int = 8 << 20, rows: int = 8000) -> Iterator:
    """The batch in parts of about most bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes, dtype="i8"), 0
    while at < batch.num_rows:
        done = int(total[at - 1]) if at else 0
        upto = max(at + 1, min(at + rows, int(np.searchsorted(total, done + most, "right"))))
        yield batch.slice(at, upto - at)
        at = upto


def gathered(batches, column: str, least: int = 6 << 20) -> Iterator:
    """Batches put together until they have at least so many bytes of text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += pc.sum(pc.fill_null(pc.binary_length(batch.column(column)), 0)).as_py() or 0
        if size >= least:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def released() -> None:
    """Give memory that a task has freed back to the system: Python workers live on between tasks, beside the JVM's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
