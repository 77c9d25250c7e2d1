"""A bounded table of distinct chunks and what a tokenizer makes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class ChunkTable:
    """Segments each distinct chunk once and serves repeats from memory.

    At most ``limit`` chunks of at most ``longest`` characters are kept per
    task; what does not fit is segmented whenever it comes up, so results do
    not depend on the limits.
    """

    def __init__(self, segment: Callable[[list[str]], Iterable], limit: int = 500_000, longest: int = 64):
        self.segment, self.limit, self.longest, self.known = segment, limit, longest, {}

    def __call__(self, chunks: list[str]) -> list:
        """One value for each chunk, by position."""
        known = self.known
        new = list(set(chunks).difference(known))
        if not new:
            return list(map(known.__getitem__, chunks))
        made = dict(zip(new, self.segment(new)))
        values = [made[c] if (v := known.get(c)) is None else v for c in chunks]
        if len(known) < self.limit:
            known.update((c, v) for c, v in made.items() if len(c) <= self.longest)
        return values
