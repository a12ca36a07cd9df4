"""DataFrame -> DataFrame operators: joins, ordered operations, aggregates, shares,
bootstrap, statistics, validation rules and brand resolution."""
