"""Training-data operators: archives, chat repair, decontamination, search, extraction, mixing, scoring and joins."""
