"""Column helpers and small statistical functions shared by the operators."""
