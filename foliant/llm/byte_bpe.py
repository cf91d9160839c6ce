"""Byte-level BPE in linear time: longest matches, pair compatibility, backtracking.

A token sequence is the one that rank-ordered merging gives exactly if every
adjacent pair is compatible, that is, if merging the bytes of the two tokens
gives these two tokens again.  So an encoder may walk from left to right, take
the longest vocabulary entry that is compatible with the token before it, try
shorter ones, and step back where none fits.  The encoding of each prefix is
unique, so a position that failed once never has to be entered again, which
bounds the work by the number of vocabulary matches.

The longest matches come from the trie of an Aho-Corasick automaton over
strings in which each character stands for one byte (Latin-1).  Many short
pieces walk side by side over the same trie as an array, each by one token, or
one back, in a step.

Texts are taken as one array of bytes, many at a time.  Where the pattern is the
usual one, classes of characters give the pieces; the ids of pieces met before
are looked up in arrays, compared byte by byte.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import once_per_worker

#: By the words of eight bytes that a kept piece may have: the bits of the places for such pieces.
KEPT_PLACES = {1: 18, 2: 19, 4: 19}
#: Ids up to which a piece is kept.
KEPT_IDS = 8
#: Pairs of which a worker keeps whether they are compatible, and what follows from it.
KEPT_PAIRS = 400_000
#: Pieces and ids that are handled at a time, and characters of texts.
AT_ONCE, CHARACTERS_AT_ONCE = 200_000, 1 << 20
#: Bytes up to which a piece walks beside others, and places for pairs met on the way.
WALKED_BYTES, PAIR_BITS = 256, 19


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file's lines: base64 of the bytes, a space, the rank."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: Words with the blank before them, and runs of white space.  Each match is split by the
#: usual patterns (letters, digits and signs with an optional blank, white space apart)
#: just as it is inside the whole text, so a long text can be taken in parts.
WORD_WISE = (
    r" ?[^ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    r"|[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    r"(?![^ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"
    r"|[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)

#: The pattern that is applied to arrays of bytes, see ``Splitter``; others are matched.
BY_CLASS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Classes of characters in it; ``END`` is the byte after each text, which UTF-8 never has.
SPACE, LETTER, NUMBER, SIGN, END = range(5)
END_BYTE = b"\xff"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions from each start on, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Splitter:
    """The matches of ``BY_CLASS`` in many texts at once."""

    def __init__(self):
        import regex

        points = [*range(0xD800), *range(0xE000, 0x110000)]
        characters, points = "".join(map(chr, points)), np.array(points)
        self.classes = np.full(0x110000, SIGN, dtype=np.uint8)
        for name, group in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for match in regex.finditer(group, characters):
                self.classes[points[match.start() : match.end()]] = name
        self.of_bytes = np.full(256, SIGN, dtype=np.uint8)
        self.of_bytes[:128], self.of_bytes[255] = self.classes[:128], END

    def classified(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        classes = self.of_bytes[data]
        leads = np.flatnonzero((data >= 0xC0) & (data < 0xFF))
        if len(leads):
            first = data[leads]
            sizes = 2 + (first >= 0xE0) + (first >= 0xF0)
            points = (first & (0x7F >> sizes)).astype(np.int64)
            for i in (1, 2, 3):
                on = sizes > i
                points[on] = points[on] << 6 | data[leads[on] + i] & 0x3F
            found = self.classes[points]
            for i in range(4):
                on = sizes > i
                classes[leads[on] + i] = found[on]
        return classes

    def starts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a match or the end of a text begins, and which are matches.

        An end follows each text.
        """
        classes = self.classified(data)
        begins = np.ones(len(data), dtype=bool)
        np.not_equal(classes[1:], classes[:-1], out=begins[1:])
        # the last of some white space is apart: a blank goes with what follows
        after = np.flatnonzero(begins[1:] & (classes[:-1] == SPACE) & (classes[1:] != END)) + 1
        blank = data[after - 1] == 0x20
        begins[after[blank] - 1], begins[after[blank]] = True, False
        last = after[~blank] - 1
        while len(inside := np.flatnonzero(data[last] & 0xC0 == 0x80)):
            last[inside] -= 1
        begins[last] = True
        # 's 't 'm 'd 're 've 'll
        quotes = np.flatnonzero((data[:-1] == 0x27) & (classes[1:] == LETTER) & begins[:-1])
        if len(quotes):
            one, two = data[quotes + 1], data[np.minimum(quotes + 2, len(data) - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
            pair = one.astype(np.int64) << 8 | two
            long = np.isin(pair, [int.from_bytes(both) for both in (b"re", b"ve", b"ll")])
            begins[quotes[short | long] + 1] = False
            begins[quotes[short] + 2] = True
            begins[quotes[long] + 3] = True
        starts = np.flatnonzero(begins)
        return starts, classes[starts] != END


class Kept:
    """Ids of pieces of up to some words of eight bytes; a new piece takes the place of an older."""

    def __init__(self, words: int, bits: int, never: int):
        self.words, self.bits = words, bits
        self.keys = np.zeros((1 << bits, words), dtype=np.uint64)
        self.counts = np.zeros(1 << bits, dtype=np.uint8)  # 0: none is kept here
        self.ids = np.zeros((1 << bits, KEPT_IDS), dtype=np.min_scalar_type(never))

    #: By the bytes that a piece has in a word: the others, set to what UTF-8 never has.
    REST = np.array([(1 << 64) - (1 << 8 * n) for n in range(9)], dtype=np.uint64)

    def keys_of(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of each piece, filled up; ``data`` goes on for as many bytes."""
        words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
        keys = np.empty((len(starts), self.words), dtype=np.uint64)
        for i in range(self.words):
            keys[:, i] = words[starts + 8 * i]
            keys[:, i] |= self.REST[np.clip(sizes - 8 * i, 0, 8)]
        return keys

    @staticmethod
    def mixed(keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=np.uint64)
        for i in range(keys.shape[1]):
            found ^= keys[:, i]
            found *= np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
        return found * np.uint64(0xBF58476D1CE4E5B9)

    def places(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether the pieces are kept at their places."""
        same = self.counts[places] > 0
        for i in range(self.words):
            same &= self.keys[places, i] == keys[:, i]
        return same

    def put(self, places, keys, counts, starts, ids: np.ndarray) -> None:
        """Keep pieces, whose ids begin at ``starts``; one per place."""
        places, one = np.unique(places, return_index=True)
        few = counts[one] <= KEPT_IDS
        places, one = places[few], one[few]
        self.keys[places], self.counts[places] = keys[one], counts[one]
        for i in range(KEPT_IDS):
            on = counts[one] > i
            self.ids[places[on], i] = ids[starts[one[on]] + i]


class Walk:
    """The walk over many pieces of UTF-8 at once: one token of each in a step."""

    def __init__(self, coder: Coder):
        self.coder, self.never = coder, coder.never
        nodes: dict[str, int] = {"": 0}
        inner = {token[:i] for token in coder.usable for i in range(len(token))}
        for node in chain(sorted(inner, key=len), coder.usable):
            nodes.setdefault(node, len(nodes))  # those with children come first
        self.inner = max(len(inner), 1)
        #: By node with children and byte: the next node; 0 where there is none.
        self.next = np.zeros(self.inner << 8, dtype=np.int32)
        #: By node: the longest usable token up to it; by token: the longest shorter one.
        self.best = np.full(len(nodes), -1, dtype=np.int64)
        self.shorter = np.full(self.never, -1, dtype=np.int64)
        for node in sorted(nodes, key=len):
            if not node:
                continue
            at, above = nodes[node], nodes[node[:-1]]
            self.next[above << 8 | ord(node[-1])] = at
            token = coder.usable.get(node)
            self.best[at] = self.best[above] if token is None else token
            if token is not None:
                self.shorter[token] = self.best[above]
        self.next[255::256] = 0  # never in UTF-8: it stands after each piece
        parts = [(token, halves) for token, halves in coder.split.items() if halves]
        self.first, self.second = (np.full(self.never, -1, dtype=np.int64) for _ in range(2))
        for token, (left, right) in parts:
            self.first[token], self.second[token] = left, right
        merges = sorted(
            (left * self.never + right, rank)
            for token, rank in coder.ranks.items() for i in range(1, len(token))
            if (left := coder.ranks.get(token[:i])) is not None
            and (right := coder.ranks.get(token[i:])) is not None
        )
        self.merged = np.array([*merges, (1 << 62, self.never)], dtype=np.int64).T.copy()
        #: Pairs of a token and the longest match after it, and the token that follows.
        self.pairs = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.chosen = np.zeros(1 << PAIR_BITS, dtype=np.int32)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Coder.compatible`` for arrays."""
        good, live = np.ones(len(left), dtype=bool), np.arange(len(left))
        a, b = left, right
        until_a, until_b = np.full(len(a), self.never), np.full(len(a), self.never)
        keys, ranks = self.merged
        while len(live):
            pair = a * self.never + b
            at = np.searchsorted(keys, pair)
            across = np.where(keys[at] == pair, ranks[at], self.never)
            apart = (across >= until_a) | (across > until_b) | (across == self.never)
            good[live[~apart]] = False
            part_a, part_b = self.second[a], self.first[b]
            of_a = (part_a >= 0) & ((part_b < 0) | (a > b))
            of_b = ~of_a & (part_b >= 0)
            until_a, until_b = np.where(of_a, a, until_a), np.where(of_b, b, until_b)
            a, b = np.where(of_a, part_a, a), np.where(of_b, part_b, b)
            on = np.flatnonzero(apart & (of_a | of_b))
            live, a, b, until_a, until_b = live[on], a[on], b[on], until_a[on], until_b[on]
        return good

    def following(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``Coder.following`` for arrays; a pair that was met before is looked up."""
        pair = last * self.never + token
        place = (pair * 0x9E3779B97F4A7C1 & 0xFFFFFFFFFFFFFFF) >> (60 - PAIR_BITS)
        found = self.chosen[place].astype(np.int64)
        unknown = np.flatnonzero(self.pairs[place] != pair)
        if len(unknown):
            new, which = np.unique(pair[unknown], return_inverse=True)
            lasts, tokens = np.divmod(new, self.never)
            open_ = np.arange(len(new))
            while len(open_):
                open_ = open_[~self.compatible(lasts[open_], tokens[open_])]
                tokens[open_] = self.shorter[tokens[open_]]
                open_ = open_[tokens[open_] >= 0]
            found[unknown] = tokens[which]
            slots, one = np.unique(place[unknown], return_index=True)
            self.pairs[slots] = pair[unknown[one]]
            self.chosen[slots] = found[unknown[one]]
        return found

    def longest(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest usable token at each position; else -1."""
        reached = np.zeros(len(at), dtype=np.int64)
        live, node = np.arange(len(at)), reached
        while len(live):
            step = self.next[node << 8 | data[at]]
            on = np.flatnonzero(step)
            live, node, at = live[on], step[on].astype(np.int64), at[on] + 1
            reached[live] = node
            on = np.flatnonzero(node < self.inner)
            live, node, at = live[on], node[on], at[on]
        return self.best[reached]

    def pieces(self, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        """The number of ids of each piece that begins in the text, and all these ids.

        Kept by position: the token that begins there, where the token that ends there begins,
        and whether the walk has failed there.
        """
        ends = np.cumsum(sizes + 1) - 1
        starts, lengths = ends - sizes, self.coder.lengths
        data = np.full(int((sizes + 1).sum()), 255, dtype=np.uint8)
        data[spread(starts, sizes)] = text[spread(begin, sizes)]
        begins, came = np.full(len(data), -1), np.full(len(data), -1)
        failed = np.zeros(len(data), dtype=bool)
        at, end = starts[sizes > 0], ends[sizes > 0]
        last, token = np.full(len(at), -1), np.full(len(at), -2)  # as in Coder.piece
        while len(at):
            new = np.flatnonzero(token == -2)
            token[new] = self.longest(data, at[new])
            open_ = np.flatnonzero(token >= 0)
            while len(open_):
                some = open_[last[open_] >= 0]
                token[some] = self.following(last[some], token[some])
                open_ = open_[token[open_] >= 0]
                open_ = open_[failed[at[open_] + lengths[token[open_]]]]
                token[open_] = self.shorter[token[open_]]
                open_ = open_[token[open_] >= 0]
            on, stuck = np.flatnonzero(token >= 0), np.flatnonzero(token < 0)
            here, taken = at[on], token[on]
            begins[here] = taken
            at[on] = here + lengths[taken]
            came[at[on]] = here
            last[on], token[on] = taken, -2
            if len(stuck):
                here = at[stuck]
                failed[here] = True
                before = came[here]
                if (before < 0).any():
                    raise ValueError("the rank table lacks a byte of the text")
                earlier = came[before]
                at[stuck] = before
                last[stuck] = np.where(earlier < 0, -1, begins[earlier])
                token[stuck] = self.shorter[begins[before]]
            on = np.flatnonzero(at < end)
            at, end, last, token = at[on], end[on], last[on], token[on]
        first = np.zeros(len(data), dtype=bool)
        at, end = starts[sizes > 0], ends[sizes > 0]
        while len(at):
            first[at] = True
            at = at + lengths[begins[at]]
            on = np.flatnonzero(at < end)
            at, end = at[on], end[on]
        before = np.concatenate([[0], np.cumsum(first)])
        return before[ends] - before[starts], begins[first]


class Coder:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, stretches: str | None = None):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.never = max(ranks.values(), default=0) + 1
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.by_class = Splitter() if pattern == BY_CLASS else None
        self.stretches = re.compile(stretches) if stretches else None
        self.split: dict[int, tuple[int, int] | None] = {}
        self.usable = {  # tokens that merging can produce at all
            token.decode("latin-1"): rank
            for token, rank in ranks.items() if len(token) == 1 or self.halves(rank)
        }
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.prefixes: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.chosen: dict[int, int] = {}
        self.heads: dict[str, int] = {}
        order = sorted(ranks.values())
        sizes = np.zeros(self.never, dtype=np.int64)
        sizes[order] = [len(self.bytes_of[rank]) for rank in order]
        self.lengths, self.starts = sizes, np.cumsum(sizes) - sizes
        self.joined = np.frombuffer(b"".join(self.bytes_of[rank] for rank in order), np.uint8)
        self.kept = [Kept(words, bits, self.never) for words, bits in KEPT_PLACES.items()]
        #: Tokens that merging cannot produce, for pieces that are such a token as a whole.
        self.unusable = {
            token: rank for token, rank in ranks.items() if token.decode("latin-1") not in self.usable
        }
        self.walk = Walk(self)

    # -- one piece ---------------------------------------------------------

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte or where none does."""
        if token not in self.split:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
                best = min((rank for rank in joined if rank is not None), default=None)
                if best is None:
                    break
                at = joined.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            two = len(parts) == 2
            self.split[token] = tuple(self.ranks[part] for part in parts) if two else None
        return self.split[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they meet.

        Goes back through the merges on both sides of the border, the later one
        first.  In each state the parts at the border must not form a token
        that is merged before one of them is merged into its own token; of
        equal ranks the one further left is merged first.
        """
        pair = left * self.never + right
        known = self.pairs.get(pair)
        if known is not None:
            return known
        known, a, b, until_a, until_b = True, left, right, self.never, self.never
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < until_a and across <= until_b:
                known = False
                break
            parts_a, parts_b = self.halves(a), self.halves(b)
            if parts_a and (not parts_b or a > b):
                until_a, a = a, parts_a[1]
            elif parts_b:
                until_b, b = b, parts_b[0]
            else:
                break
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest usable token among the proper prefixes of a token; else -1."""
        if token not in self.prefixes:
            data = self.bytes_of[token].decode("latin-1")
            found = (self.usable.get(data[:n]) for n in range(len(data) - 1, 0, -1))
            self.prefixes[token] = next((other for other in found if other is not None), -1)
        return self.prefixes[token]

    def longest_of(self, head: str) -> int:
        """The longest usable token that a string begins with; else -1.

        ``head`` is a path in the trie of the tokens, so there are no more of them than nodes.
        """
        token, length = None, len(head)
        while token is None and length:
            token = self.usable.get(head[:length])
            length -= 1
        token = -1 if token is None else token
        self.heads[head] = token
        return token

    def following(self, last: int, token: int) -> int:
        """The longest token compatible with the one before, from ``token`` on to its prefixes."""
        key = last * self.never + token
        found = self.chosen.get(key)
        if found is not None:
            return found
        found = token
        while found >= 0 and not self.compatible(last, found):
            found = self.shorter(found)
        if found != token:
            if len(self.chosen) >= KEPT_PAIRS:
                self.chosen.clear()
            self.chosen[key] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself in the table is one token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, size, longest = data.decode("latin-1"), len(data), self.longest
        reach, heads, sizes, pairs = (
            self.automaton.longest_prefix, self.heads.get, self.sizes, self.pairs.get
        )
        never, failed = self.never, set()
        taken: list[int] = []
        at, last, token = 0, -1, -2  # -1: none, -2: not yet looked for
        while at < size:
            if token == -2:
                head = text[at : at + longest]
                head = head[: reach(head)]
                token = heads(head)
                if token is None:
                    token = self.longest_of(head)
            while token >= 0:
                if last >= 0 and not pairs(last * never + token):
                    token = self.following(last, token)
                    if token < 0:
                        break
                if failed and at + sizes[token] in failed:
                    token = self.shorter(token)
                else:
                    break
            if token >= 0:
                taken.append(token)
                at += sizes[token]
                last, token = token, -2
            elif taken:
                failed.add(at)
                dropped = taken.pop()
                at -= sizes[dropped]
                last, token = taken[-1] if taken else -1, self.shorter(dropped)
            else:
                raise ValueError("the rank table lacks a byte of the text")
        return taken

    # -- many pieces -------------------------------------------------------

    def new(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """The number of ids of each piece, where they begin, and the ids."""
        counts, begin = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        walked = sizes <= WALKED_BYTES
        known = np.flatnonzero(np.isin(sizes, [len(token) for token in self.unusable]))
        alone = {}
        for i in [*known.tolist(), *np.flatnonzero(~walked).tolist()]:
            piece = data[starts[i] : starts[i] + sizes[i]].tobytes()
            if piece in self.unusable or not walked[i]:
                alone[i] = self.piece(piece)
                walked[i] = False
        counts[walked], ids = self.walk.pieces(data, starts[walked], sizes[walked])
        begin[walked] = np.cumsum(counts[walked]) - counts[walked]
        end = len(ids)
        for i, own in alone.items():
            counts[i], begin[i] = len(own), end
            end += len(own)
        return counts, begin, np.concatenate([ids, *alone.values()]).astype(np.int64)

    def coded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """The number of ids of each piece of UTF-8, and all ids; data goes on behind the pieces.

        Pieces that are kept are looked up, of the others each different one is encoded once.
        """
        counts, begin = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        flat, end, least, open_, new_keys, which, unknown = [], 0, 0, [], [], [], 0
        for kept in self.kept:
            some = np.flatnonzero((sizes > least) & (sizes <= 8 * kept.words))
            least = 8 * kept.words
            keys = kept.keys_of(data, starts[some], sizes[some])
            mixed = kept.mixed(keys)
            places = kept.places(mixed)
            has = kept.has(places, keys)
            hit, miss = np.flatnonzero(has), np.flatnonzero(~has)
            counts[some[hit]] = kept.counts[places[hit]]
            begin[some[hit]] = end + KEPT_IDS * np.arange(len(hit))
            flat.append(kept.ids[places[hit]].reshape(-1))
            end += len(flat[-1])
            _, one, of = np.unique(mixed[miss], return_index=True, return_inverse=True)
            if (keys[miss[one]][of] != keys[miss]).any():  # two pieces of one hash
                _, one, of = np.unique(keys[miss], axis=0, return_index=True, return_inverse=True)
            open_.append(some[miss])
            which.append(of.reshape(-1) + unknown)
            unknown += len(one)
            new_keys.append((kept, some[miss[one]], places[miss[one]], keys[miss[one]]))
        long = np.flatnonzero(sizes > least)
        numbers: dict[bytes, int] = {}
        of = [
            numbers.setdefault(data[a : a + n].tobytes(), len(numbers))
            for a, n in zip(starts[long].tolist(), sizes[long].tolist())
        ]
        open_.append(long)
        which.append(np.array(of, dtype=np.int64) + unknown)
        _, one = np.unique(which[-1], return_index=True)
        new = np.concatenate([*(pieces for _, pieces, _, _ in new_keys), long[one]])
        new_counts, new_begin, ids = self.new(data, starts[new], sizes[new])
        at = 0
        for kept, pieces, places, keys in new_keys:
            until = at + len(pieces)
            kept.put(places, keys, new_counts[at:until], new_begin[at:until], ids)
            at = until
        open_, which = np.concatenate(open_), np.concatenate(which)
        counts[open_], begin[open_] = new_counts[which], end + new_begin[which]
        return counts, np.concatenate([*flat, ids])[spread(begin, counts)]

    # -- texts -------------------------------------------------------------

    #: Bytes that stand behind the pieces, as the keys of kept pieces read on.
    BEHIND = bytes(8 * max(KEPT_PLACES))

    def of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``coded`` for pieces that were matched one by one."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join([*pieces, self.BEHIND]), dtype=np.uint8)
        return self.coded(data, np.cumsum(sizes) - sizes, sizes)

    def together(self, texts: list[str]) -> list[bytes]:
        """Packed ids of some texts."""
        if self.by_class is None:
            split = [[p.encode() for p in self.pattern.findall(text)] for text in texts]
            counts, ids = self.of_pieces(list(chain.from_iterable(split)))
            ends = np.cumsum([len(pieces) for pieces in split], dtype=np.int64)
        else:
            joined = END_BYTE.join([*(text.encode() for text in texts), b""])
            data = np.frombuffer(joined + self.BEHIND, dtype=np.uint8)
            own = data[: len(joined)]
            borders, within = self.by_class.starts(own)
            starts, sizes = borders[within], np.diff(borders, append=len(own))[within]
            counts, ids = self.coded(data, starts, sizes)
            ends = np.searchsorted(starts, np.flatnonzero(own == END_BYTE[0]))
        packed = ids.astype("<u4").tobytes()
        until = 4 * np.concatenate([[0], np.cumsum(counts)])[ends]
        return [packed[a:b] for a, b in zip([0, *until.tolist()], until.tolist())]

    def parts(self, text: str) -> Iterator[str]:
        """Parts of a long text that the pattern splits as it does within the text.

        None ends in white space, for there patterns look at what follows.
        """
        begin = 0
        for match in self.stretches.finditer(text) if self.stretches else ():
            end = match.end()
            if end - begin >= CHARACTERS_AT_ONCE and not text[end - 1].isspace():
                yield text[begin:end]
                begin = end
        yield text[begin:]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        packed = []
        for part in self.parts(text or ""):
            if len(part) <= 2 * CHARACTERS_AT_ONCE:
                packed += self.together([part])
                continue
            found = (match.group().encode() for match in self.pattern.finditer(part))
            while some := list(islice(found, AT_ONCE)):
                packed.append(self.of_pieces(some)[1].astype("<u4").tobytes())
        return b"".join(packed)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """``encode`` for each text; short ones are taken together."""
        some: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if size and size + len(text) > CHARACTERS_AT_ONCE:
                yield from self.together(some)
                some, size = [], 0
            if len(text) > CHARACTERS_AT_ONCE:
                yield from self.together(some)
                some = []
                yield self.encode(text)
            else:
                some.append(text)
                size += len(text)
        yield from self.together(some)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that packed ids stand for, from one buffer of all tokens."""
        numbers = np.frombuffer(ids or b"", dtype="<u4")
        parts = []
        for begin in range(0, len(numbers), AT_ONCE):
            some = numbers[begin : begin + AT_ONCE]
            lengths = self.lengths[some]
            if not lengths.all():
                raise KeyError("an id that no token has")
            parts.append(self.joined[spread(self.starts[some], lengths)].tobytes())
        return b"".join(parts)


def coding(spark: SparkSession, ranks_path: str, pattern: str, stretches: str | None = None):
    """Functions from Column to Column: text to packed ids, packed ids to bytes.

    ``ranks_path`` is read on the driver; its content (under a megabyte for the
    usual vocabularies) travels to the workers as a broadcast, and each worker
    builds its automaton once.  ``stretches`` may name a coarser standard-library
    pattern, such as ``WORD_WISE``, each match of which ``pattern`` splits as it
    does within the text; a long text is then taken in parts of such matches.  A null
    text is empty and gives no ids; null ids give no bytes.  The ids are those of whole
    rows: none is sampled or cut.
    """
    with open(ranks_path, "rb") as file:
        content = file.read()
    sent = spark.sparkContext.broadcast(content)
    name = ("byte-bpe", hash(content), pattern, stretches)

    def coder() -> Coder:
        return once_per_worker(name, lambda: Coder(parse_ranks(sent.value), pattern, stretches))

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        own = coder()
        return pa.array(own.encode_all(texts.to_numpy(zero_copy_only=False)), type=pa.binary())

    @F.arrow_udf("binary")
    def decode(packed: pa.Array) -> pa.Array:
        own = coder()
        return pa.array((own.decode(p.as_py()) for p in packed), type=pa.binary())

    def to_ids(text: Column) -> Column:
        return encode(text)

    def to_bytes(ids: Column) -> Column:
        return decode(ids)

    return to_ids, to_bytes
