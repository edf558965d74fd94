"""Token counts by a finite-state transducer compiled from a merge-type model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rushlight.llm.pieces import SPACE, PieceModel, model_bytes, model_of

CHUNK = 128  # characters of a chunk; all chunks of a slice advance together
SLICE_CHARS = 4_000_000  # characters taken together
MAX_STATES = 200_000  # states kept before the table starts again
GUESS = 32  # characters before a chunk from which its entry state is guessed
MAX_ROUNDS = 64  # guesses of entry states per chunk before the rest is walked one chunk after the other
MAX_CELLS = 128 << 20  # cells (state, class) of 5 bytes at which it starts again; bounds a worker's memory
START, WORD = 0, 1  # states: nothing read yet, and a word's mark just read


class CountTransducer:
    """Deterministic transducer whose transitions carry how much the number of tokens changes.

    Merge encodings have one property that makes them finite-state: the last token of a prefix is the only known
    piece that fits the last token of the prefix before it. So a state is what later pieces can still look back on:
    the longest end of the text that begins some piece, and for each place in it the last token there and the number
    of tokens up to there, relative to now. Reading a character appends a place; the emitted number is the change of
    the token count, and the sum over a text is its count.

    Words start afresh where no piece runs over their mark: there every state moves to ``WORD``. Characters
    outside the vocabulary give their bytes (or one unknown) and move to ``START``; those that give as many tokens are one
    class. States are made when first met, in dense tables (state, character class); past ``max_states`` states or
    ``max_cells`` cells the table starts again with the states in use, which costs time only. Twice what is in use, and
    what one character more of every chunk adds, may go beyond these bounds.
    """

    def __init__(self, model: PieceModel, max_states: int = MAX_STATES, max_cells: int = MAX_CELLS):
        self.model, self.max_states, self.max_cells = model, max_states, max_cells
        self.heads = {p[:n] for p in model.ids for n in range(1, len(p))}
        self.classes = np.zeros(0x110000, np.int32)  # 0: not met yet
        self.letters: list[str] = [""]
        self.others: dict[int, int] = {}  # tokens of a character outside the vocabulary -> class
        self.live: list[np.ndarray] = []  # arrays of states in use, -1 for none
        self.reset()

    def reset(self) -> None:
        self.keys: list[tuple] = []
        self.in_use = 0
        self.numbers: dict[tuple, int] = {}
        width = max(64, 1 << (len(self.letters)).bit_length())
        self.next = np.full((1024, width), -1, np.int32)
        self.emit = np.zeros((1024, width), np.int8)
        self.state(("", ((-1, 0),)))
        if self.model.splits_words:
            mark = self.model.ids.get(SPACE)
            self.state((SPACE, ((-1, -1), (mark, 0))))

    def state(self, key: tuple) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            if number == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return number

    def room(self) -> int:
        """States at which the table starts again; tables grow by doubling, so half of the cells count."""
        return max(min(self.max_states, self.max_cells // (2 * self.next.shape[1])), 2 * self.in_use)

    def shrink(self, states: np.ndarray) -> np.ndarray:
        """Start the table again with the states in use, renumbered in ``live``; returns ``states`` renumbered."""
        fixed = np.arange(min(2, len(self.keys)))  # START, WORD
        used = np.unique(np.concatenate([fixed, states, *[a[a >= 0] for a in self.live]]))
        number = np.full(len(self.keys), -1, np.int64)
        number[used] = np.arange(len(used))
        for a in self.live:
            a[a >= 0] = number[a[a >= 0]]
        keys = [self.keys[u] for u in used]
        self.reset()
        for key in keys:
            self.state(key)
        self.in_use = len(used)
        return number[states]

    def letter_class(self, codes: np.ndarray) -> np.ndarray:
        """Classes of characters, numbering those not met before."""
        found = self.classes[codes]
        if not found.all():
            for code in np.unique(codes[found == 0]):
                letter = chr(code)
                number = len(self.letters)
                if letter not in self.model.known:
                    number = self.others.setdefault(self.unknown(letter), number)
                if number == len(self.letters):
                    self.letters.append(letter)
                self.classes[code] = number
            if len(self.letters) > self.next.shape[1]:
                self.reset()  # between slices no state is in use
            found = self.classes[codes]
        return found

    def unknown(self, letter: str) -> int:
        """Tokens of a character outside the vocabulary."""
        return len(letter.encode("utf-8", "surrogatepass")) if self.model.byte_fallback else 1

    def step(self, number: int, letter: str) -> tuple[int, int]:
        """The transition of a state: (next state, change of the token count)."""
        model = self.model
        if letter not in model.known:
            return START, self.unknown(letter)
        tail, places = self.keys[number]
        tail += letter
        for back in range(len(tail)):  # the longest piece first
            token = model.ids.get(tail[back:])
            if token is not None and model.fits(places[back][0], token):
                count = places[back][1] + 1
                break
        keep = next((b for b in range(len(tail)) if tail[b:] in self.heads), len(tail))
        left = tuple([(t, c - count) for t, c in places[keep:]]) + ((token, 0),)
        return self.state((tail[keep:], left)), count

    def run(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Advance many states by one character each; missing transitions are made."""
        to = self.next[states, classes]
        if (to < 0).any():
            if len(self.keys) > self.room():
                states = self.shrink(states)
                to = self.next[states, classes]
            width = self.next.shape[1]
            lacking = to < 0
            for pair in np.unique(states[lacking].astype(np.int64) * width + classes[lacking]):
                state, letter = divmod(int(pair), width)
                after, change = self.step(state, self.letters[letter])
                self.next[state, letter], self.emit[state, letter] = after, change
            to = self.next[states, classes]
        return to, self.emit[states, classes]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text.

        The texts are laid end to end and cut into chunks. A chunk's state map sends an entry state to an exit state and
        a count. Where the chunk has a word mark, the map is constant from there on, and the part from its first mark
        is run for all chunks at once. The heads before the marks, and chunks without one, get their map over the entry
        states that can come up: see ``maps``. A scan composes the maps by doubling, so that a stretch of n chunks
        without a mark takes log n rounds. Counts per text are differences of the running sum.
        """
        self.live = []
        if len(self.keys) > self.room():
            self.reset()
        mark = SPACE if self.model.dummy_prefix else ""
        laid = [mark + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, laid), np.int64, len(laid))
        codes = np.frombuffer("".join(laid).encode("utf-32-le", "surrogatepass"), np.uint32)
        total = len(codes)
        out = np.zeros(len(texts), np.int64)
        if not total:
            return out
        first = np.zeros(total + 1, bool)
        starts = np.cumsum(sizes) - sizes
        first[starts] = True
        first = first[:total]
        classes = self.letter_class(codes).astype(np.int64)
        is_mark = codes == ord(SPACE)
        fresh = is_mark.copy()
        fresh[1:] &= ~is_mark[:-1]
        fresh = fresh & self.model.splits_words | first & is_mark & self.model.splits_words
        changes = np.zeros(total, np.int16)
        lanes = -(-total // CHUNK)
        pad = lanes * CHUNK - total
        grid_fresh = np.concatenate([fresh, np.zeros(pad, bool)]).reshape(lanes, CHUNK)
        grid_first = np.concatenate([first, np.zeros(pad, bool)]).reshape(lanes, CHUNK)
        known = grid_fresh | grid_first
        opens = np.where(known.any(axis=1), known.argmax(axis=1), CHUNK)
        exits = np.full(lanes, -1, np.int64)

        def advance(lane: np.ndarray, state: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Run lanes from column ``begin`` to ``end``; returns their exit states."""
            state = state.copy()
            self.live = [exits, state]
            for column in range(int(begin.min()), int(end.max())):
                on = np.flatnonzero((begin <= column) & (column < end))
                at = lane[on] * CHUNK + column
                inside = at < total
                on, at = on[inside], at[inside]
                here = np.where(first[at], START, state[on])
                renew = fresh[at]
                moved, change = self.run(np.where(renew, START, here), classes[at])
                state[on] = np.where(renew, WORD, moved)
                changes[at] = np.where(renew, 1, change)
            return state

        own = np.flatnonzero(opens < CHUNK)
        if len(own):
            exits[own] = advance(own, np.zeros(len(own), np.int64), opens[own], np.full(len(own), CHUNK))
        waiting = np.flatnonzero(opens > 0)
        if len(waiting):
            lane, entry, left, count = self.maps(classes, opens, exits, waiting)
            real = compose(lane, entry, left, opens, exits)
            through = real & (opens[lane] == CHUNK)
            exits[lane[through]] = left[through]
            changes[lane[real] * CHUNK] = count[real]  # no text ends inside a head: its count may stand at its start
            waiting = np.setdiff1d(waiting, lane[real])
        while len(waiting):  # what ``MAX_ROUNDS`` guesses left open
            entry = exits[waiting - 1]
            ready = waiting[entry >= 0]
            end = opens[ready]
            left = advance(ready, exits[ready - 1], np.zeros(len(ready), np.int64), end)
            through = end == CHUNK
            exits[ready[through]] = left[through]
            waiting = waiting[entry < 0]
        running = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
        return running[starts + sizes] - running[starts]


    def maps(
        self, classes: np.ndarray, opens: np.ndarray, exits: np.ndarray, lanes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """State maps of the heads of chunks ``lanes``: (chunk, entry state, exit state, tokens), sorted by the first two.

        A chunk behind one with a known exit has that entry alone. Any other is entered by a guess, read from the
        ``GUESS`` characters before it alone, and by all exits of the chunk before it. All chunks advance together, round by round, until no entry is new: different
        entries soon meet in one state, or go round a few, as the places of a repeated letter do.
        """
        new_lane, new_entry = lanes, exits[lanes - 1].copy()
        unsure = np.flatnonzero(new_entry < 0)
        guess = np.full(len(unsure), START)
        self.live = [exits, new_entry, guess]
        for back in range(GUESS, 0, -1):
            if len(unsure):
                guess[:] = self.run(guess, classes[lanes[unsure] * CHUNK - back])[0]
        new_entry[unsure] = guess
        lane = entry = left = count = np.zeros(0, np.int64)
        for _ in range(MAX_ROUNDS):
            state, sums = new_entry.copy(), np.zeros(len(new_lane), np.int64)
            entry, left, new_entry = entry.copy(), left.copy(), new_entry.copy()
            self.live = [exits, entry, left, new_entry, state]
            end = np.minimum(opens[new_lane], len(classes) - new_lane * CHUNK)
            for column in range(int(end.max())):
                on = np.flatnonzero(column < end)
                state[on], change = self.run(state[on], classes[new_lane[on] * CHUNK + column])
                sums[on] += change
            lane, entry = np.concatenate([lane, new_lane]), np.concatenate([entry, new_entry])
            left, count = np.concatenate([left, state]), np.concatenate([count, sums])
            on = np.flatnonzero(opens[new_lane] == CHUNK)
            on = on[new_lane[on] + 1 < len(opens)]
            on = on[opens[new_lane[on] + 1] > 0]
            asked = np.setdiff1d(_pair(new_lane[on] + 1, state[on]), _pair(lane, entry))
            if not len(asked):
                break
            new_lane, new_entry = asked >> 32, asked & 0xFFFFFFFF
        order = np.argsort(_pair(lane, entry))
        return lane[order], entry[order], left[order], count[order]


def _pair(lane: np.ndarray, state: np.ndarray) -> np.ndarray:
    return lane.astype(np.int64) << 32 | state.astype(np.int64)


def compose(lane: np.ndarray, entry: np.ndarray, left: np.ndarray, opens: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Which rows of the state maps the text takes, by doubling: maps of one chunk, two, four and so on are composed, and
    each time the rows known to be taken reach twice as far."""
    n = len(lane)
    keys = _pair(lane, entry)
    after = _pair(lane + 1, left)
    at = np.minimum(np.searchsorted(keys, after), n - 1)
    ahead = np.where((opens[lane] == CHUNK) & (keys[at] == after), at, n)  # n: the stretch ends
    ahead = np.append(ahead, n)
    real = np.append(exits[lane - 1] >= 0, False)
    while (ahead < n).any():
        real[ahead[real]] = True
        ahead = ahead[ahead]
    return real[:n]


_transducers: dict[int, CountTransducer] = {}


def transducer_of(data: bytes) -> CountTransducer:
    """The transducer of a model, once per Python worker."""
    key = hash(data)
    if key not in _transducers:
        _transducers[key] = CountTransducer(model_of(data))
    return _transducers[key]


def count_tokens(df: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens); one row in, one out.

    Counts are those of the model's own library for whole texts without begin, end or added tokens. Null and empty
    texts have 0 bytes and 0 tokens. Rows keep their number and repeats; columns with the added names are replaced.
    There is no shuffle; a task holds one Arrow batch, the tables of a bounded number of states and a few numbers per
    character of a slice.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(model_bytes(spark, model))
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = transducer_of(data.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts, start = [], 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= SLICE_CHARS):
                    chars += len(texts[end])
                    end += 1
                counts.append(transducer.count(texts[start:end]))
                start = end
            made = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "n_tokens"])

    counted = kept.mapInArrow(run, schema)
    return counted.select(
        "*",
        F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("bigint").alias("n_bytes"),
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
