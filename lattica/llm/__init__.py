"""Training-data operators: joins on word shingles, decontamination, scans, mixing, rules, scoring, fixity and substring de-duplication.

Nothing outside this folder imports it.
"""
