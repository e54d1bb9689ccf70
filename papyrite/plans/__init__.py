"""Registered queries, one module per capability."""

from papyrite.plans import agent, answers, documents, foundation, relational, rounds, search, streams, trees

REGISTRIES = [m.REGISTRY for m in (foundation, search, relational, documents, trees, agent, rounds, answers, streams)]
