"""Fieldloom: controller-project analytics expressed as Spark plans."""
