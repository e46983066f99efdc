"""Named-node graphs, their validation and (partial) evaluation, and layered configuration."""
