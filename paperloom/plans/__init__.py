"""Plans: inspection, audits and the ordered size-reducing passes over the tables of a corpus."""
