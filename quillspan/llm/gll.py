"""A generalised LL recogniser: every alternative is followed at once over a graph-structured stack.

A grammar maps a nonterminal to its alternatives, each a sequence of symbols. A symbol is a
nonterminal, or else the kind of a token; ``#KIND`` takes the token and notes its place (the name of
a function). ``!`` as the first symbol marks an alternative of error recovery: a parse that needs it
costs one error, and of the parses of a text the one with fewest errors stands, then the longest.
"""

from __future__ import annotations

Grammar = dict[str, list[tuple[str, ...]]]


class Recogniser:
    def __init__(self, grammar: Grammar, start: str) -> None:
        self.start = start
        self.symbol: list[str | None] = []  # of each slot; None ends an alternative
        self.call: list[bool] = []
        self.note: list[bool] = []
        nullable = self._nullable(grammar)
        first = self._first(grammar, nullable)
        self.entries: dict[str, list[tuple[int, frozenset[str] | None, int]]] = {}
        for name, alternatives in grammar.items():
            rows = []
            for alt in alternatives:
                cost = int(bool(alt) and alt[0] == "!")
                body = alt[cost:]
                ahead: set[str] | None = set()
                for s in body:
                    if s in grammar:
                        ahead |= first[s]
                        if s in nullable:
                            continue
                    else:
                        ahead.add(s.lstrip("#"))
                    break
                else:
                    ahead = None  # may be empty: any token may follow
                rows.append((len(self.symbol), None if ahead is None else frozenset(ahead), cost))
                for s in body:
                    self.symbol.append(s.lstrip("#"))
                    self.call.append(s in grammar)
                    self.note.append(s[0] == "#")
                self.symbol.append(None)
                self.call.append(False)
                self.note.append(False)
            self.entries[name] = rows

    @staticmethod
    def _nullable(g: Grammar) -> set[str]:
        out: set[str] = set()
        while True:
            more = {n for n, alts in g.items() if n not in out and any(all(s == "!" or s in out for s in a) for a in alts)}
            if not more:
                return out
            out |= more

    @staticmethod
    def _first(g: Grammar, nullable: set[str]) -> dict[str, set[str]]:
        first: dict[str, set[str]] = {n: set() for n in g}
        changed = True
        while changed:
            changed = False
            for n, alts in g.items():
                for a in alts:
                    for s in a:
                        if s == "!":
                            continue
                        new = first[s] if s in g else {s.lstrip("#")}
                        if not new <= first[n]:
                            first[n] |= new
                            changed = True
                        if s not in nullable:
                            break
        return first

    def parse(self, tokens: list[str], at: int = 0) -> tuple[int, int, int] | None:
        """(errors, place after the parse, place of the noted token) of the best parse from ``at``."""
        symbol, call, note, entries = self.symbol, self.call, self.note, self.entries
        n = len(tokens)
        # a node of the stack is (slot to return to, place of the call); edges lead to the callers
        root = (-1, at)
        edges: dict[tuple[int, int], list] = {root: []}
        popped: dict[tuple[int, int], set] = {root: set()}
        work: list[tuple] = []
        seen: set[tuple] = set()
        best: tuple[int, int, int] | None = None

        def enter(name: str, node: tuple[int, int], i: int, noted: int, errors: int) -> None:
            t = tokens[i] if i < n else ""
            for slot, ahead, cost in entries[name]:
                if ahead is None or t in ahead:
                    d = (slot, node, i, noted, errors + cost)
                    if d not in seen:
                        seen.add(d)
                        work.append(d)

        enter(self.start, root, at, -1, 0)
        while work:
            slot, node, i, noted, errors = work.pop()
            while True:
                s = symbol[slot]
                if s is None:
                    if node is root or node == root:
                        if best is None or (errors, -i) < (best[0], -best[1]):
                            best = (errors, i, noted)
                        break
                    done = popped[node]
                    if (i, noted, errors) in done:
                        break
                    done.add((i, noted, errors))
                    for parent in edges[node]:
                        d = (node[0], parent, i, noted, errors)
                        if d not in seen:
                            seen.add(d)
                            work.append(d)
                    break
                if call[slot]:
                    child = (slot + 1, i)
                    known = edges.get(child)
                    if known is None:
                        edges[child] = [node]
                        popped[child] = set()
                        enter(s, child, i, noted, errors)
                    else:
                        if node not in known:
                            known.append(node)
                            for j, m, e in popped[child]:
                                d = (slot + 1, node, j, m, e)
                                if d not in seen:
                                    seen.add(d)
                                    work.append(d)
                        enter(s, child, i, noted, errors)
                    break
                if i < n and tokens[i] == s:
                    if note[slot]:
                        noted = i
                    i += 1
                    slot += 1
                    continue
                break
        return best
