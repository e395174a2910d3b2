"""DataFrame operators: dataflow, evidence, state, reports, sequences."""
