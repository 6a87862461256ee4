"""Ledgerline: shipment checking, evidence retrieval and audit trails as Spark plans."""
