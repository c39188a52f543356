"""A cuckoo filter that keeps its keys, so that hits are verified and it can grow."""

from __future__ import annotations

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Digests with a payload of [smallest id, copies, copies that have that id].

    A digest has two buckets, the second reachable from the first by its
    fingerprint alone. A lookup compares fingerprints in both buckets and then the
    stored digest, so it is never wrong. When kicks find no free slot the table
    doubles and is filled again from the stored digests.
    """

    def __init__(self, expected: int = 64):
        size = 8
        while size * SLOTS * 0.9 < expected:
            size *= 2
        self._clear(size)

    def _clear(self, size: int) -> None:
        self.size = size
        self.prints = [[] for _ in range(size)]
        self.content = [[] for _ in range(size)]
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") | 1 << 16
        first = int.from_bytes(digest[:8], "little") & (self.size - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 >> 7) & (self.size - 1)

    def find(self, digest: bytes) -> list | None:
        """The entry [digest, smallest id, copies, copies with that id], or None."""
        print_, first, second = self._places(digest)
        for bucket in (first, second):
            if print_ in self.prints[bucket]:
                for entry in self.content[bucket]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, doc_id, copies: int = 1, firsts: int = 1) -> bool:
        """Add copies, of which ``firsts`` have this id; True if the digest was not live."""
        entry = self.find(digest)
        if entry is None:
            self._place([digest, doc_id, copies, firsts])
            return True
        if doc_id == entry[1]:
            entry[3] += firsts
        elif entry[1] is None or (doc_id is not None and doc_id < entry[1]):
            entry[1], entry[3] = doc_id, firsts
        entry[2] += copies
        return False

    def _place(self, entry: list) -> None:
        print_, first, second = self._places(entry[0])
        for bucket in (first, second):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(print_)
                self.content[bucket].append(entry)
                self.live += 1
                return
        bucket = second
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            self.prints[bucket][slot], print_ = print_, self.prints[bucket][slot]
            self.content[bucket][slot], entry = entry, self.content[bucket][slot]
            bucket = self._other(bucket, print_)
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(print_)
                self.content[bucket].append(entry)
                self.live += 1
                return
        self._grow(entry)

    def _grow(self, homeless: list) -> None:
        entries = [*self.entries(), homeless]
        self._clear(self.size * 2)
        for entry in entries:
            self._place(entry)

    def delete(self, digest: bytes, copies: int = 1) -> bool:
        """Take copies away; True if the digest is no longer live. Unknown digests stay unknown."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[2] -= copies
        if entry[2] > 0:
            return False
        print_, first, second = self._places(digest)
        for bucket in (first, second):
            for slot, other in enumerate(self.content[bucket]):
                if other is entry:
                    del self.prints[bucket][slot], self.content[bucket][slot]
                    self.live -= 1
                    return True
        raise AssertionError("a found entry has a slot")

    def entries(self):
        for bucket in self.content:
            yield from bucket
