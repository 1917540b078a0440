"""Levenshtein automata over a lexicon trie."""

from __future__ import annotations


class Trie:
    """Terms, each either a whole word or a stem that any ending may follow."""

    def __init__(self, terms: list[tuple[str, bool]]):
        """terms: a term, and whether it is a stem."""
        self.root: dict = {None: 0}
        for term, stem in terms:
            node, most = self.root, edits(term, stem)
            for c in term:
                node[None] = max(node[None], most)
                node = node.setdefault(c, {None: 0})
            node[None] = max(node[None], most)
            node[""] = (term, stem, most)

    @property
    def most(self) -> int:
        """The most edits of any term; at a node, None has the most of those below."""
        return self.root[None]


def edits(term: str, stem: bool) -> int:
    """How many edits a misspelling of the term may have. Words of four letters may have one replaced (see ``nearest``); shorter ones, and
    stems of fewer than seven letters, which begin many words, are only found as spelt."""
    n = len(term)
    return int(n >= 7) if stem else (n >= 4) + (n >= 12)


class Automaton:
    """The deterministic Levenshtein automaton of a word: its states are sets of (letters of the word used, edits made).

    States are made when a search first reaches them, and kept while the word is looked up."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most
        self.start = self._closed({(0, 0)})
        self._steps: dict[tuple[frozenset, str], frozenset] = {}

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the letters of the word that may be left out; a state that another one covers is dropped."""
        best: dict[int, int] = {}
        for i, e in states:
            while i <= len(self.word) and e <= self.most:
                if best.get(i, self.most + 1) > e:
                    best[i] = e
                i, e = i + 1, e + 1
        return frozenset(best.items())

    def step(self, state: frozenset, letter: str) -> frozenset:
        key = state, letter
        if key not in self._steps:
            out = set()
            for i, e in state:
                out.add((i, e + 1))
                if i < len(self.word):
                    out.add((i + 1, e + (self.word[i] != letter)))
            self._steps[key] = self._closed({s for s in out if s[1] <= self.most})
        return self._steps[key]

    def edits_whole(self, state: frozenset) -> int:
        """Edits at the end of the word, more than allowed if the state isn't there."""
        return min((e for i, e in state if i == len(self.word)), default=self.most + 1)

    def edits_begun(self, state: frozenset) -> int:
        """Edits so far, whatever follows in the word."""
        return min((e for _, e in state), default=self.most + 1)


def nearest(trie: Trie, word: str) -> tuple[str, int] | None:
    """The lexicon term that the word is or misspells, and its edits: the fewest, then the longest term, then the first by name."""
    automaton, found = Automaton(word, trie.most), []
    stack = [(trie.root, automaton.start)]
    while stack:
        node, state = stack.pop()
        for letter, below in node.items():
            if letter is None:
                continue
            if letter == "":
                term, stem, allowed = below
                e = automaton.edits_begun(state) if stem else automaton.edits_whole(state)
                short = len(term) == 4 and not stem
                if e <= allowed and not (short and e and len(word) != 4):
                    found.append((e, -len(term), term))
            else:
                after = automaton.step(state, letter)
                if automaton.edits_begun(after) <= below[None]:
                    stack.append((below, after))
    if not found:
        return None
    e, _, term = min(found)
    return term, e
