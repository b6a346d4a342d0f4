"""Table operators: keys, pairing of rows, cells, roll-ups, profiles, type inference, anomalies."""
