"""Texts as white-space chunks with small integer codes, for work that is done once per distinct chunk."""

from __future__ import annotations

import numpy as np


class Codes(dict):
    """Chunk to code; unseen chunks get the next code and are noted in ``new``. The empty chunk is code 0."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code

    def of(self, texts: list[str | None], other_breaks: str = "") -> tuple[np.ndarray, np.ndarray]:
        """``(codes, sizes)``: codes of all chunks of all texts, and how many each text has (one at least).

        Spaces, line feeds and ``other_breaks`` each end a chunk, so a chunk's place in its text follows from the
        lengths of those before it.
        """
        sizes, codes = np.empty(len(texts), np.int64), []
        for k, text in enumerate(texts):  # the strings of one text at a time
            text = (text or "").replace("\n", " ")
            for mark in other_breaks:
                text = text.replace(mark, " ")
            own = text.split(" ")
            sizes[k] = len(own)
            codes.append(np.fromiter(map(self.__getitem__, own), np.int32, len(own)))
        return np.concatenate(codes) if codes else np.zeros(0, np.int32), sizes
