"""tracelode: a Spark-native engine that finds typed artefacts in text and binary corpora."""
