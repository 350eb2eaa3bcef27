"""Written tables that cut lineage, in the shared folder that the cluster names."""

from tagweave.sources.store import drop_saved as drop_written
from tagweave.sources.store import saved as written
from tagweave.sources.store import shared_folder

__all__ = ["drop_written", "shared_folder", "written"]
