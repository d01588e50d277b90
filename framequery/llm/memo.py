"""What Python workers remember between batches, bounded in bytes, and runs of texts of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: About the bytes that an entry takes beside its key's and value's own characters.
ENTRY = 130


class Memo:
    """bytes -> bytes in two generations: when the young one has ``most`` bytes it becomes the old one, so that entries
    in use stay. It takes 2 * most and one batch of new entries at most."""

    def __init__(self, most: int):
        self.most, self.used = most, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, keys: list[bytes]) -> list[bytes | None]:
        """The values that are known; those of the old generation are taken over."""
        found = list(map(self.young.get, keys))
        if self.old:
            held = {k: self.old[k] for k, v in zip(keys, found, strict=True) if v is None and k in self.old}
            if held:
                self.put(held)
                found = [held.get(k) if v is None else v for k, v in zip(keys, found, strict=True)]
        return found

    def put(self, new: dict[bytes, bytes]) -> None:
        if self.used > self.most:
            self.old, self.young, self.used = self.young, {}, 0
        self.young.update(new)
        self.used += ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))


def grouped(texts: Iterable, most: int) -> Iterator[list]:
    """Runs of texts of about so many bytes or characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
