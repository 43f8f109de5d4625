"""DataFrame operators: shaping, features, windows, normalisation, alarms, evaluation, exploration, hand-off."""
