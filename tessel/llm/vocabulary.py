"""Unigram probabilities of an existing SentencePiece vocabulary."""

from __future__ import annotations

import math

import numpy as np
import sentencepiece


class Trie:
    """The pieces as a trie whose moves are looked up for many nodes at once.

    Moves are the integers node * characters + character in an open-addressing table, so a look-up is exact.
    """

    def __init__(self, piece_id: dict[str, int]):
        codes = sorted({ord(c) for p in piece_id for c in p})
        self.code = np.zeros(max(codes, default=0) + 2, dtype=np.int64)
        self.code[codes] = np.arange(1, len(codes) + 1)  # 0: in no piece
        self.width = len(codes) + 1
        moves: dict[int, int] = {}
        piece = [-1]
        for p, k in piece_id.items():
            node = 0
            for c in p:
                move = node * self.width + int(self.code[ord(c)])
                if move not in moves:
                    moves[move] = len(piece)
                    piece.append(-1)
                node = moves[move]
            piece[node] = k
        self.piece = np.array(piece, dtype=np.int64)
        self.bits = max(10, len(moves).bit_length() + 3)
        self.moves, self.target = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        keys = np.fromiter(moves, dtype=np.int64, count=len(moves))
        for slot, move in zip(self._slot(keys).tolist(), keys.tolist(), strict=True):
            while self.moves[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.moves[slot], self.target[slot] = move, moves[move]

    def _slot(self, moves: np.ndarray) -> np.ndarray:
        return ((moves.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The trie's numbers of code points."""
        return self.code[np.minimum(codes, len(self.code) - 1)]

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Where each node's character leads, -1 if nowhere."""
        want = nodes * self.width + chars
        slot = self._slot(want)
        found = self.moves[slot]
        out = np.where(found == want, self.target[slot], -1)
        open_ = np.flatnonzero((found != want) & (found >= 0))  # taken by another move: look on
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.moves[slot[open_]]
            hit = found == want[open_]
            out[open_[hit]] = self.target[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Pieces with natural-log probabilities.

    A unigram model's scores are log probabilities and are used as they are (normalized). A BPE model's scores are
    minus the rank of the merge: there a piece of rank r gets the Zipf weight 1 / (r + 10). Characters and markers of
    rank-less pieces come last. A character without a piece of its own is spelled in byte pieces.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = np.array([sp.get_score(i) for i in normal])
        if np.all(scores == np.round(scores)):
            order = np.argsort(-scores, kind="stable")
            rank = np.empty(len(normal))
            rank[order] = np.arange(len(normal))
            logs = -np.log(rank + 10)
        else:
            logs = scores
        names = [pieces[i] for i in normal]
        # Byte pieces share the weight of one average character.
        floor = float(logs.min())
        self.piece_id = {p: k for k, p in enumerate(names)}
        self.byte_at = len(names)
        logs = np.concatenate([logs, np.full(256, floor)])
        self.log_p = logs - math.log(np.exp(logs - logs.max()).sum()) - logs.max()
        self.longest = max(map(len, names), default=1)
        self._trie: Trie | None = None

    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.piece_id)
        return self._trie

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None}  # each worker builds its own

    def __len__(self) -> int:
        return len(self.log_p)

    def byte_ids(self, char: str) -> list[int]:
        return [self.byte_at + b for b in char.encode("utf-8", "surrogatepass")]
