"""Operators for preparing training text: forms, languages, pieces, site lines, labels, copies, pairs, ids, mixes, subjects."""
