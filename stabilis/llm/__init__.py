"""Training-data operators: duplicate removal, mixing, scoring, search, privacy and licences."""
