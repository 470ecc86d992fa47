"""Network specification: variables, ordered parents, column mapping, tracks.

A ``NetworkSpec`` is a small driver-side description of a discrete Bayesian
network over the columns of a table.  Every operator in the package takes a
spec, so the same code fits the default ten-node network, the ``docs`` network
or any user network.  Parent order matters: conditional tables back off along
parent *prefixes*.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    name: str
    column: str
    parents: tuple[str, ...] = ()
    description: str = ""

    def is_root(self) -> bool:
        return not self.parents


@dataclass
class NetworkSpec:
    nodes: list[Node]
    target: str
    tracks: dict[str, list[str]] = field(default_factory=dict)
    key: str = "case_id"
    order_col: str = "term"

    def __post_init__(self):
        self._by_name = {n.name: n for n in self.nodes}
        for n in self.nodes:
            for p in n.parents:
                if p not in self._by_name:
                    raise ValueError(f"{n.name}: unknown parent {p}")

    # -- lookups ---------------------------------------------------------
    @property
    def names(self) -> list[str]:
        """Node names in topological order (the order nodes were declared)."""
        return [n.name for n in self.nodes]

    def node(self, name: str) -> Node:
        return self._by_name[name]

    def column(self, name: str) -> str:
        return self._by_name[name].column

    def parents(self, name: str) -> list[str]:
        return list(self._by_name[name].parents)

    def children(self, name: str) -> list[str]:
        return [n.name for n in self.nodes if name in n.parents]

    @property
    def max_parents(self) -> int:
        return max((len(n.parents) for n in self.nodes), default=0)

    @property
    def edges(self) -> list[tuple[str, str, int]]:
        """(parent, child, position) for every edge."""
        return [(p, n.name, i + 1) for n in self.nodes for i, p in enumerate(n.parents)]

    def track(self, track: str | list[str] | None) -> list[str]:
        """Evidence variables of a track (never the target)."""
        if track is None:
            names = self.names
        elif isinstance(track, str):
            names = self.tracks[track]
        else:
            names = list(track)
        return [n for n in names if n != self.target and n in self._by_name]

    def restrict(self, columns, by_name: bool = False) -> "NetworkSpec":
        """Drop nodes whose column (or, with by_name, node name) is absent, and
        drop them as parents too."""
        present = set(columns)
        keep = [n for n in self.nodes if (n.name if by_name else n.column) in present]
        names = {n.name for n in keep}
        nodes = [Node(n.name, n.column, tuple(p for p in n.parents if p in names),
                      n.description) for n in keep]
        tracks = {k: [v for v in vs if v in names] for k, vs in self.tracks.items()}
        return NetworkSpec(nodes, self.target, tracks, self.key, self.order_col)

    def with_parents(self, graph: dict[str, list[str]]) -> "NetworkSpec":
        """Same variables, new structure ({node: [parents]})."""
        nodes = [Node(n.name, n.column, tuple(graph.get(n.name, [])), n.description)
                 for n in self.nodes]
        order = topological_order([n.name for n in nodes],
                                  {n.name: list(n.parents) for n in nodes})
        by = {n.name: n for n in nodes}
        return NetworkSpec([by[x] for x in order], self.target, self.tracks,
                           self.key, self.order_col)

    def ancestors(self, names) -> set[str]:
        out, stack = set(), list(names)
        while stack:
            v = stack.pop()
            for p in self.parents(v):
                if p not in out:
                    out.add(p)
                    stack.append(p)
        return out


def topological_order(names: list[str], parents: dict[str, list[str]]) -> list[str]:
    """Kahn order, ties by declaration order."""
    done: list[str] = []
    left = list(names)
    while left:
        for v in left:
            if all(p in done for p in parents.get(v, [])):
                done.append(v)
                left.remove(v)
                break
        else:
            raise ValueError("graph has a cycle")
    return done


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------

# Default network: node -> (column, ordered parents), in topological order.
DEFAULT_NODES = [
    ("chief_justice", "chief", ()),
    ("issue_area", "issueArea", ()),
    ("law_type", "lawType", ()),
    ("case_supplement", "caseDispositionUnusual", ()),
    ("lower_court_disposition", "lcDisposition", ()),
    ("decision_type", "decisionType", ("issue_area", "law_type")),
    ("precedent_alteration", "precedentAlteration", ("issue_area", "lower_court_disposition")),
    ("split_vote", "voteSplit", ("issue_area", "law_type")),
    ("unconstitutional", "declarationUncon", ("law_type", "case_supplement")),
    ("final_disposition", "caseDisposition",
     ("decision_type", "precedent_alteration", "split_vote", "unconstitutional", "chief_justice")),
]

DEFAULT_TRACKS = {
    "explanatory": ["chief_justice", "issue_area", "law_type", "case_supplement",
                    "lower_court_disposition", "decision_type", "precedent_alteration",
                    "split_vote", "unconstitutional"],
    "ex_ante": ["chief_justice", "issue_area", "law_type", "lower_court_disposition"],
}

# Node descriptions.
NODE_DESCRIPTIONS = {
    "chief_justice": "Chief Justice presiding over the case",
    "issue_area": "Area of law at issue (civil rights, criminal procedure, etc.)",
    "law_type": "Type of law involved (constitutional, statutory, etc.)",
    "case_supplement": "Supplemental case context",
    "lower_court_disposition": "How the lower court disposed of the case",
    "decision_type": "Type of Supreme Court decision",
    "precedent_alteration": "Whether existing precedent is altered",
    "split_vote": "Whether the justices split on the decision",
    "unconstitutional": "Whether the case involves an unconstitutionality finding",
    "final_disposition": "Final Supreme Court case disposition (the prediction target)",
}

# Labels of the target codes.
DISPOSITION_LABELS = {
    1: "Stay, petition, or motion granted",
    2: "Affirmed (includes modified)",
    3: "Reversed",
    4: "Reversed and remanded",
    5: "Vacated and remanded",
    6: "Affirmed and reversed (or vacated) in part",
    7: "Affirmed and reversed in part and remanded",
    8: "Vacated",
    9: "Petition denied or appeal dismissed",
    10: "Certification to or from a lower court",
    11: "No disposition",
}

# Binary affirm / reverse task.
BINARY_AFFIRM = (2,)
BINARY_REVERSE = (3, 4, 5, 8)
BINARY_LABELS = {0: "Affirmed", 1: "Reversed / vacated"}

# Default hyper-parameters of the fit.
DEFAULT_ALPHA = 1.0
DEFAULT_M = 5.0
DEFAULT_TEST_FRACTION = 0.2
DEFAULT_SEED = 42
LOG_CLIP = 1e-12


def default_spec() -> NetworkSpec:
    nodes = [Node(n, c, tuple(p)) for n, c, p in DEFAULT_NODES]
    return NetworkSpec(nodes, target="final_disposition", tracks=DEFAULT_TRACKS,
                       key="case_id", order_col="term")


def docs_spec() -> NetworkSpec:
    """Second network, on the ``docs`` view: lang, source, length -> toxic -> quality."""
    nodes = [
        Node("lang", "lang"),
        Node("source", "source"),
        Node("length", "len_bucket"),
        Node("toxic", "toxic", ("lang", "length")),
        Node("quality", "quality", ("toxic", "length", "source")),
    ]
    return NetworkSpec(nodes, target="quality",
                       tracks={"all": ["lang", "source", "length", "toxic"],
                               "text_only": ["lang", "source", "length"]},
                       key="doc_id", order_col="doc_id")
