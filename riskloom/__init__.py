"""riskloom: rule-based risk detection, its evaluation and corpus operators, on Spark."""
