"""Landing-file readers, the table store and result serialisation."""
