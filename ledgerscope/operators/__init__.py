"""DataFrame operators: sequence windows, user statistics, rules,
features, evaluation tables, neighbour joins and outlier models."""
