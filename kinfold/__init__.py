"""Spark-native item co-occurrence analytics: mining, tests, networks, mixtures, strata."""
