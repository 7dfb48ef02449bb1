"""Shortest-pack-first packing of a length histogram into patterns."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each.

    Lengths are placed longest first, each into the pack that is shortest so
    far, for all packs and pieces of the same kind at once; a new pack is begun
    where not even the shortest has room.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # by room: [pattern, count]
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            done.append((pattern, count))
            return
        if not open_packs[room]:
            heappush(rooms, -room)
        open_packs[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            if not rooms or -rooms[0] < length:
                put((length,), left, capacity - length)
                break
            room = -rooms[0]
            pack = open_packs[room][-1]
            take = min(left, pack[1])
            pack[1] -= take
            left -= take
            pattern = (*pack[0], length)
            if not pack[1]:
                open_packs[room].pop()
                if not open_packs[room]:
                    heappop(rooms)
            put(pattern, take, room - length)
    for room in sorted(open_packs):
        done += [(tuple(p), n) for p, n in open_packs[room]]
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for pattern, count in done:
        merged[pattern] += count
    return sorted(merged.items(), reverse=True)
