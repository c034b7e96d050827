"""An editable collection of documents over workbook sheets."""

from .documents import Collection, Document
from .workbook import SheetDocument, WorkbookStore

__all__ = ["Collection", "Document", "SheetDocument", "WorkbookStore"]
