"""Mixture-model and clustering analytics, declared as Spark DataFrame plans."""
