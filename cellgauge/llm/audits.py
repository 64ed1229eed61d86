"""Edit sequences as persistent linked nodes, and the cheapest repair of a conversation's roles over them."""

from __future__ import annotations

from dataclasses import dataclass

# Modulus and base of the rolling hash.
MODULUS, BASE = (1 << 61) - 1, 1_000_003

# What has been put out: nothing, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# Where a turn with an initial may follow. Initials of the roles, and the legal order s?(ua)+ or nothing.
FOLLOWS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
FINAL = (START, ASSISTANT)
MADE = FOLLOWS["u"] + FOLLOWS["a"]


@dataclass(frozen=True)
class Costs:
    """Cost of each edit. A truncated turn that is not deleted costs ``truncated`` besides."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audits:
    """Sequences that share their prefixes: a node is its parent's sequence and one symbol more. Ancestors 1, 2, 4 ...
    steps back and a rolling hash of the whole sequence make the longest common prefix of two a search over levels."""

    def __init__(self) -> None:
        self.symbol, self.tag, self.depth, self.hashed = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def add(self, parent: int, symbol: int, tag) -> int:
        up, k = [parent], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        self.symbol.append(symbol)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        self.hashed.append((self.hashed[parent] * BASE + symbol + 1) % MODULUS)
        return len(self.symbol) - 1

    def ancestor(self, node: int, depth: int) -> int:
        back, k = self.depth[node] - depth, 0
        while back:
            if back & 1:
                node = self.up[node][k]
            back, k = back >> 1, k + 1
        return node

    def path(self, node: int) -> list[int]:
        """Nodes from the first symbol to ``node``."""
        out = []
        while node:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]

    def same(self, a: int, b: int) -> bool:
        """Whether two sequences of equal depth are equal, symbol by symbol down to a shared node."""
        while a != b:
            if self.symbol[a] != self.symbol[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's sequence comes before b's. The first difference lies just under the deepest pair of ancestors with
        equal hashes; that their sequences are equal is verified, and after a collision symbols decide."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hashed[x] == self.hashed[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
        else:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hashed[self.up[x][k]] != self.hashed[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            if self.same(self.up[x][0], self.up[y][0]):
                return self.symbol[x] < self.symbol[y]
        return [self.symbol[n] for n in self.path(a)] < [self.symbol[n] for n in self.path(b)]


class Best:
    """Cheapest sequence for each state; among equally cheap ones the least."""

    def __init__(self, audits: Audits) -> None:
        self.audits = audits
        self.cost: list[int | None] = [None] * 4
        self.node = [0] * 4

    def offer(self, state: int, cost: int, parent: int, symbol: int, tag) -> bool:
        held = self.cost[state]
        if held is not None and held < cost:
            return False
        node = self.audits.add(parent, symbol, tag)
        if held == cost and not self.audits.less(node, self.node[state]):
            return False
        self.cost[state], self.node[state] = cost, node
        return True


D, I, K, R = map(ord, "DIKR")


def insert(best: Best, costs: Costs) -> None:
    """Turns put in where that makes a state cheaper, any number of them."""
    again = True
    while again:
        again = False
        for a, b in MADE:
            if best.cost[a] is not None and (best.cost[b] is None or best.cost[a] + costs.insert <= best.cost[b]):
                again |= best.offer(b, best.cost[a] + costs.insert, best.node[a], I, "U" if b == USER else "A")


def edit(best: Best, initial: str, truncated: bool, costs: Costs) -> Best:
    """One turn kept, given another role or deleted, after any inserts."""
    insert(best, costs)
    out = Best(best.audits)
    more = costs.truncated * truncated
    for s in STATES:
        if best.cost[s] is not None:
            out.offer(s, best.cost[s] + costs.delete, best.node[s], D, "D")
    for a, b in FOLLOWS.get(initial, ()):
        if best.cost[a] is not None:
            out.offer(b, best.cost[a] + more, best.node[a], K, "K")
    for a, b in MADE:
        if best.cost[a] is not None:
            out.offer(b, best.cost[a] + costs.rerole + more, best.node[a], R, "u" if b == USER else "a")
    return out


def drop(best: Best, times: int, costs: Costs) -> Best:
    """A run of turns that must be deleted, as one symbol."""
    insert(best, costs)
    out = Best(best.audits)
    for s in STATES:
        if best.cost[s] is not None:
            out.offer(s, best.cost[s] + costs.delete * times, best.node[s], D, "D" * times)
    return out


def transfers(turns: list[tuple[str, bool, int, int]], entries, costs: Costs) -> list[tuple[int, int, int, int, str]]:
    """(entry, exit, cost, rank, edits) of a stretch of turns for each state before it and after it: the cheapest edits, least of
    equals, and their rank among those of the same entry. ``turns``: initial, truncated, 1 if the turn itself counts, and
    how many deletions follow. Edits are one token a turn: inserts (U, A) and K, u, a, or D; each token ends in one of the latter, so
    no sequence is the beginning of another, and ranks settle every comparison of longer ones. Tokens are parted by blanks."""
    out = []
    for entry in entries:
        audits = Audits()
        best = Best(audits)
        best.cost[entry] = 0
        for initial, truncated, counts, dropped in turns:
            if counts:
                best = edit(best, initial, truncated, costs)
            if dropped:
                best = drop(best, dropped, costs)
        ends = [s for s in STATES if best.cost[s] is not None]
        for s in ends:
            rank = sum(audits.less(best.node[t], best.node[s]) for t in ends)
            tokens, held, at = [], "", 0
            # A turn that counts and is followed by deletions has two symbols, but one token.
            rows = [i for i, (_, _, counts, dropped) in enumerate(turns) for _ in range(bool(counts) + bool(dropped))]
            for node in audits.path(best.node[s]):
                held += audits.tag[node]
                if audits.symbol[node] != I:
                    if at and rows[at] == rows[at - 1]:
                        tokens[-1] += held
                    else:
                        tokens.append(held)
                    held, at = "", at + 1
            out.append((entry, s, best.cost[s], rank, " ".join(tokens)))
    return out


class Chain:
    """Stretches of one conversation put together in order: nodes are stretches, symbols the ranks of their edits."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.audits = costs, Audits()
        self.best = Best(self.audits)
        self.best.cost[START] = 0

    def extend(self, key, found: list[tuple[int, int, int, int]]) -> None:
        """found: (entry, exit, cost, rank)."""
        out = Best(self.audits)
        for entry, leave, cost, rank in found:
            if self.best.cost[entry] is not None:
                out.offer(leave, self.best.cost[entry] + cost, self.best.node[entry], rank, (key, entry, leave))
        self.best = out

    def finish(self) -> tuple[int, str, list[tuple]]:
        """cost, inserts at the end, (key, entry, exit) of each stretch."""
        # The last inserts come after all ranks; fewer are less, and of equal cost there is one number of them.
        options = []
        for state in STATES:
            cost, node, tail, at = self.best.cost[state], self.best.node[state], "", state
            if cost is None:
                continue
            while at not in FINAL:
                at, letter = (ASSISTANT, "A") if at == USER else (USER, "U")
                cost, tail = cost + self.costs.insert, tail + letter
            options.append((cost, node, tail))
        cost, node, tail = options[0]
        for c, n, t in options[1:]:
            if c < cost or c == cost and self.audits.less(n, node):
                cost, node, tail = c, n, t
        return cost, tail, [self.audits.tag[x] for x in self.audits.path(node)]
